"""Token ids of whole texts by a given public tokenizer, with a cache of words.

A byte-level or word tokenizer cuts a text before a space or a line's end that a non-blank follows, so the ids of a text are
those of its pieces between them; a word tokenizer gives blanks no ids. The distinct pieces of some texts, which Arrow finds,
are looked up in a bounded cache, and Arrow strings their ids together; a new piece
of plain letters and signs is cut by the tokenizer's own model, any other by the whole tokenizer. A text for which the cut
would not hold (blank runs before a byte-level tokenizer, special tokens) is given whole to the tokenizer. So ids are always
those of encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII signs without the apostrophe, and letters of Latin-1 and ASCII, which no normalisation changes but for case.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: A piece that is empty or begins with a blank, but for one line end: the text is not cut at its spaces.
_UNCUT = re.compile(r"(?:^|\0)(?:\n(?:\s|\0|$)|[^\S\n]|\0|$)")
#: Texts whose pieces are looked up together.
STEP = 1024
#: Pieces, and letter runs, that are remembered; about 0.4 kB each.
MOST = 1_200_000


def _halved(cache: dict, recent: set[str]) -> None:
    """Forget the half of a cache that was learned first, but for what was asked for of late, if that is not most of it."""
    for kept in (recent, ()):
        old = list(itertools.islice(cache, len(cache) // 2))
        for key in old:
            if key not in kept:
                del cache[key]
        if len(cache) <= len(old) * 3 // 2:
            break


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """spec: the text of a tokenizers JSON file; most: pieces that are remembered."""

    def __init__(self, spec: str, most: int = MOST):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.full = Tokenizer.from_str(spec)
        model, pre = self.full.model, self.full.pre_tokenizer
        steps = json.loads(pre.__getstate__()) if pre else {}
        steps = [p.get("type") for p in steps.get("pretokenizers", [steps])]
        self.byte_level = steps == ["ByteLevel"]
        self.cached = isinstance(model, models.BPE) and (self.byte_level or steps == ["Split", "ByteLevel"] and bool(self.full.normalizer))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        #: Characters one of which is in any special token: most texts have none of them.
        self.marks = sorted({t[0] for t in self.special if t})
        self.dtype = np.uint16 if self.full.get_vocab_size() <= 65_536 else np.uint32
        #: The same model, which both share, for words that need nothing else.
        self.model = Tokenizer(model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.newline = self.letters[10]
        self.shown = {**self.letters, 10: f" {self.newline} "}
        self.stop = self.model.encode(self.newline, add_special_tokens=False).ids[0]
        vocab = self.full.get_vocab()
        #: How an id shows that a word begins (byte-level, after a blank) or ends with it; None: words are parted by line ends.
        suffix = getattr(model, "end_of_word_suffix", None)
        self.opens = self.closes = None
        if self.byte_level:
            self.opens = self._marked(vocab, lambda t: t.startswith(self.letters[32]))
        elif suffix and all(c + suffix in vocab for c in self.letters.values()):
            self.closes = self._marked(vocab, lambda t: t.endswith(suffix))
        self.pieces: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        #: Pieces of the texts since the cache was three quarters full.
        self.recent: set[str] = set()
        self.tails: dict[str, bytes] = {}
        self.line = self._whole(["\n"])[0] if self.byte_level else b""
        self.tails[""] = b""

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _marked(self, vocab: dict[str, int], f: Callable[[str], bool]) -> np.ndarray:
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[k for t, k in vocab.items() if f(t)]] = True
        return out

    def _learn_cores(self, into: dict[str, bytes], lead: str, cores: list[str]) -> None:
        """Ids of letter runs after lead, into the pieces after that lead."""
        width = self.dtype().itemsize
        opens, closes = self.opens if lead else None, self.closes
        parted = opens is None and closes is None
        for k in range(0, len(cores), 256):
            some = cores[k : k + 256]
            shown = lead + f"\n{lead}".join(some) + "\n" if parted else "\n".join(some)
            if not shown.isascii() or not self.byte_level:
                shown = (shown if self.byte_level else shown.lower()).encode().decode("latin-1")
            shown = shown.translate(self.shown if parted else self.letters)
            if not parted:
                shown = self.letters[32] * bool(lead) + shown.replace(self.newline, f" {self.letters[32] * bool(lead)}")
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype)
            if parted:
                ends = np.flatnonzero(ids == self.stop)
                begins = np.concatenate([[0], ends[:-1] + 1])
            elif opens is not None:
                begins = np.flatnonzero(opens[ids])
                ends = np.append(begins[1:], len(ids))
            else:
                ends = np.flatnonzero(closes[ids]) + 1
                begins = np.concatenate([[0], ends[:-1]])
            raw = ids.tobytes()
            into.update(zip(some, [raw[a:e] for a, e in zip((begins * width).tolist(), (ends * width).tolist(), strict=True)], strict=True))

    def _learn_tails(self, tails: list[str]) -> None:
        if len(self.tails) > self.most:
            self.tails = {"": b""}
        strange = list(set(tails).difference(self.tails))
        self.tails.update(zip(strange, self._whole(strange), strict=True))

    def _learn_plain(self, into: dict[str, bytes], lead: str, words: list[str]) -> list[str]:
        """Learn the pieces of letters and then signs after lead, and their letter runs; gives back the other pieces."""
        cores, ended, before, tails, rest = [], [], [], [], []
        for w in words:
            c = w.rstrip(_SIGNS)
            if c.isalpha() and (c.isascii() or _LATIN(c)):
                if len(c) == len(w):
                    cores.append(w)
                else:
                    ended.append(w)
                    before.append(c)
                    tails.append(w[len(c) :])
            elif c:
                rest.append(w)
            else:
                ended.append(w)
                before.append("")
                tails.append(lead + w)
        fresh = {*cores, *before}.difference(into)
        fresh.discard("")
        self._learn_cores(into, lead, list(fresh))
        self._learn_tails(tails)
        tail = self.tails
        into.update(zip(ended, [(into[c] if c else b"") + tail[t] for c, t in zip(before, tails, strict=True)], strict=True))
        return rest

    def _learn(self, new: list[str], first: bool) -> None:
        into, lead = (self.firsts, "") if first else (self.pieces, " " if self.byte_level else "")
        lined = [w for w in new if w[:1] == "\n"]
        if lined:
            new = [w for w in new if w[:1] != "\n"]
            self._learn(list({w[1:] for w in lined}.difference(self.firsts)), True)
            into.update(zip(lined, [self.line + self.firsts[w[1:]] for w in lined], strict=True))
        odd = self._learn_plain(into, lead, new)
        into.update(zip(odd, self._whole([lead + w for w in odd]), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids for each text; null counts as empty."""
        texts = [t or "" for t in texts]
        if not self.cached:
            return [np.frombuffer(x, self.dtype) for x in self._whole(texts)]
        out: list[np.ndarray | None] = [None] * len(texts)
        # There are no cycles among words and ids, and to look for some in lists this long takes a tenth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            for base in range(0, len(texts), STEP):
                self._some(texts[base : base + STEP], out, base)
        finally:
            if collects:
                gc.enable()
        return out

    def _shown(self, text: str) -> str:
        """The text with a blank before each piece, and without what its ids do not tell: for words line ends, and case in Latin-1."""
        if self.byte_level:
            return text.replace("\n", " \n")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ")
        return text.lower().replace("\n", " ")

    def _some(self, texts: list[str], out: list, base: int) -> None:
        """Ids of some texts into out from base on; each distinct piece of theirs is looked up once."""
        shown, cut, whole = [], [], []
        for k, t in enumerate(texts):
            s = self._shown(t)
            if any([c in t for c in self.marks]) and any(x in t or x in s for x in self.special):
                whole.append(k)
            else:
                cut.append(k)
                shown.append(s)
        split = pc.split_pattern(pa.array(shown, pa.large_string()), " ")
        coded, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found: list[bytes | None] = list(map(self.pieces.get, words))
        if len(self.pieces) > self.most * 3 // 4:
            self.recent.update(words)
        gaps = [i for i, v in enumerate(found) if v is None]
        heads = broken = np.zeros(0, np.int64)
        if self.byte_level:
            # A text's first piece is without a blank; it has a place of its own behind the others.
            at, heads = at.copy(), at[ends[:-1]].copy()
            at[ends[:-1]] = np.arange(len(words), len(words) + len(cut))
            gaps, broken = self._gaps(words, gaps, at, ends)
            whole += [cut[j] for j in broken.tolist()]
        new = [words[i] for i in gaps]
        gone = set(broken.tolist())
        first = [None if j in gone else words[i] for j, i in enumerate(heads.tolist())]
        known, known_first = self.pieces, self.firsts
        if len(known) + len(new) > self.most:
            _halved(known, self.recent)
            self.recent.clear()
        if len(known_first) > self.most:
            known_first.clear()
        new_first = {w for w in first if w is not None}.difference(known_first)
        if new:
            self._learn(new, False)
        if new_first:
            self._learn(list(new_first), True)
        for i, w in zip(gaps, new, strict=True):
            found[i] = known[w]
        found += [b"" if w is None else known_first[w] for w in first]
        ids = pa.array(found, pa.large_binary()).take(pa.array(at))
        _, starts, raw = ids.buffers()
        starts = np.frombuffer(starts, np.int64, len(ids) + 1) // self.dtype().itemsize
        flat = np.frombuffer(raw or b"", self.dtype, int(starts[-1]))
        starts = starts[ends].tolist()
        for j, k in enumerate(cut):
            out[base + k] = flat[starts[j] : starts[j + 1]]
        for k, of in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[base + k] = np.frombuffer(of, self.dtype)

    def _gaps(self, words: list[str], gaps: list[int], at: np.ndarray, ends: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Which unknown words are to be learned, and which texts (words by place in at, up to ends) are not cut at their spaces."""
        here, broken = at, np.zeros(0, np.int64)
        marked = np.zeros(len(words) + len(ends) - 1, bool)
        marked[at] = True
        gaps = [i for i in gaps if marked[i]]
        if gaps and _UNCUT.search("\0".join([words[i] for i in gaps])):
            uncut = np.zeros(len(marked), bool)
            uncut[[i for i in gaps if _UNCUT.search(words[i])]] = True
            bad = np.logical_or.reduceat(uncut[at], ends[:-1])
            here, broken = at[np.repeat(~bad, np.diff(ends))], np.flatnonzero(bad)
            marked[:] = False
            marked[here] = True
            gaps = [i for i in gaps if marked[i]]
        return gaps, broken


def load(path: str) -> str:
    """The tokenizer's file, read on the driver, to be sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(spec: str, most: int = MOST) -> Encoder:
    """One encoder for each tokenizer in a Python worker, so that its caches serve all the worker's tasks."""
    key = (hash(spec), most)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, most)
    return _encoders[key]


def forget() -> None:
    """Drop the worker's encoder."""
    _encoders.clear()
