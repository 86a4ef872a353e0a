"""Token ids of texts, all from the tokenizers library, each chunk encoded once a worker.

Both tokenizers cut a text by a pattern in which no piece holds a space after a
character that isn't white space: a space either begins a piece or lies among white
space. A text can thus be cut before every such space, each chunk be encoded on its own, and
the ids be joined. Normalisers of the files work character by character or within
runs of white space or of marks, which no cut divides. Chunks repeat, so their ids
are kept; new ones go through ``Tokenizer.encode_batch_fast``, several as one text. A text that
holds an added token (they may stand anywhere) is encoded whole.

Where a file's normaliser does no more than NFC, white space and lower case, chunks in
ASCII are put in lower case here and go to the same tokenizer without normaliser and
added tokens: NFC leaves ASCII as it is, and white space is in no piece anyway.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kept chunks of a worker (where its maker names no number), about 20 MB, which idle workers of later stages hold on to; full, the store stays as it is (frequent chunks
#: come early) until so many calls have passed, then starts anew. Longer chunks aren't kept.
KEPT, CALLS, KEPT_CHARS = 100_000, 2000, 64
#: New chunks encoded as one text, characters of texts and chunks joined at a time: they bound a worker's memory.
RUN, PART_CHARS, STEP = 128, 1 << 22, 1 << 18
#: Stands between chunks that are encoded as one text, where ids alone don't tell them apart.
MARK = "\x01"
#: Normaliser and cut of a file whose ASCII chunks are put in lower case here: pieces are of letters, digits or other characters, never of white space.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Ways to tell the chunks of a run apart: marks, tokens that begin with a space, and one or two pieces a chunk.
MARKED, SPACED, ONE, TWO = "marked", "spaced", 1, 2
OTHERS = frozenset(string.punctuation)
#: A space before which a text isn't cut (nor before one at its start), and the places where one is cut else.
UNCUT, CUT = re.compile(r" (?<=\s )"), re.compile(r"(?<=\S)(?= )")


class ChunkIds:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for many texts, as bytes of a numpy type."""

    def __init__(self, path: str, kind: str = "<u4", kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.kind, self.calls = Tokenizer.from_file(path), kind, 0
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.later, self.kept = {}, KEPT if kept is None else kept
        self.code = {2: "H", 4: "I"}[np.dtype(kind).itemsize]
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        byte_level = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        words = cut.get("type") == "Sequence" and cut["pretokenizers"][0] == PIECES
        folds, suffix = words and made["normalizer"] == FOLDING, words and model.get("end_of_word_suffix")
        # a byte-level token names a space by this letter
        self.opens = self._tokens(lambda t: t.startswith("\u0120")) if byte_level and made["normalizer"] is None else None
        self.closes = self._tokens(lambda t: t.endswith(suffix)) if suffix else None
        self.plain = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "added_tokens": []})) if folds else None
        self.mark = np.frombuffer(self._single([f" {MARK}"])[0], kind)

    def _tokens(self, told) -> np.ndarray:
        """Which ids have tokens of which told is true."""
        vocabulary = self.library.get_vocab()
        table = np.zeros(max(vocabulary.values()) + 1, bool)
        table[[k for token, k in vocabulary.items() if told(token)]] = True
        return table

    def encode(self, texts: list[str], add_special_tokens: bool = False, folded: bool = False) -> list:
        """The library's encodings; folded: texts are ASCII, and the normaliser's work is done here."""
        library = self.plain if folded else self.library
        if folded:
            texts = [t.lower() for t in texts]
        # without offsets, where the library can
        return getattr(library, "encode_batch_fast", library.encode_batch)(texts, add_special_tokens=add_special_tokens)

    def _single(self, texts: list[str], folded: bool = False) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.encode(texts, add_special_tokens=False, folded=folded)]

    def _way(self, word: str) -> str | int:
        """How a chunk's end is found in a run. A space is one byte, so a byte tokenizer's run has as
        many tokens that begin with one as chunks only if each chunk begins with its own. Letters are
        at least one piece, letters and another character in ASCII two, and a piece has one token with the suffix."""
        if self.opens is not None:
            return MARKED if " " in word else SPACED
        if self.closes is not None:
            if word.isalpha():
                return ONE
            if word[-1] in OTHERS and word.isascii() and word[:-1].isalpha():
                return TWO
        return MARKED

    def _bounds(self, ids: np.ndarray, n: int, way: str | int) -> tuple[np.ndarray, np.ndarray] | None:
        """Where the ids of a run's n chunks begin and end; None if they can't be told apart."""
        if way == SPACED:
            begins = np.flatnonzero(self.opens[ids])
            return (begins, np.append(begins[1:], len(ids))) if len(begins) == n and begins[0] == 0 else None
        if way == MARKED:
            last = np.flatnonzero(ids == self.mark[-1])
            return (np.append(0, last + 1), np.append(last + 1 - len(self.mark), len(ids))) if len(last) == n - 1 else None
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (np.append(0, ends[way - 1:-1:way]), ends[way - 1::way]) if len(ends) == n * way else None

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of chunks, each a word after a space. Runs of them are one text, told apart by _way, or
        with the chunk of a control character between: it gives the same ids everywhere, the last of
        them nowhere else unless a word holds it too. A word that ends with white space (others may
        hold some) or that holds the control character where it's needed is encoded by itself, as are
        those of a run whose counts differ."""
        folds, groups = self.plain is not None, {}
        for w in words:
            if w and not w[-1].isspace():
                groups.setdefault((folds and w.isascii(), self._way(w)), []).append(w)
        found: dict[str, bytes] = {}
        for (folded, way), group in groups.items():
            if way == MARKED:
                group = [w for w in group if MARK not in w] if len(self.mark) else []
            runs, between = [group[at:at + RUN] for at in range(0, len(group), RUN)], f" {MARK} " if way == MARKED else " "
            for run, e in zip(runs, self.encode([" " + between.join(run) for run in runs], add_special_tokens=False, folded=folded)):
                ids = np.array(e.ids, self.kind)
                if (bounds := self._bounds(ids, len(run), way)) is not None:
                    raw, size = ids.tobytes(), ids.itemsize
                    found.update(zip(run, map(raw.__getitem__, map(slice, *((x * size).tolist() for x in bounds)))))
        for folded in (False, True)[:1 + folds]:
            rest = [w for w in words if w not in found and (folds and w.isascii()) == folded]
            found.update(zip(rest, self._single([" " + w for w in rest], folded)))
        return [found[w] for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.calls += 1
        if self.calls % CALLS == 0:
            self.later = {}
        out, part, chars = [], [], 0
        for text in texts:
            part.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                out += self._part(part)
                part, chars = [], 0
        return out + self._part(part) if part else out

    def _part(self, texts: list[str]) -> list[bytes]:
        # rows of chunks: of texts cut at every space, of those cut at some, and of those not cut
        plain, some = [], []
        for k, text in enumerate(texts):
            whole = any(a in text for a in self.added)
            (some if whole or text.startswith(" ") or UNCUT.search(text) else plain).append((k, whole))
        cut = pc.split_pattern(pa.array([texts[k] for k, _ in plain], pa.large_string()), " ")
        # a later chunk is named without the space that it begins with
        other = [[texts[k]] if whole else [c[j > 0:] for j, c in enumerate(CUT.split(texts[k]))] for k, whole in some]
        flat = pa.concat_arrays([cut.flatten(), pa.array([c for row in other for c in row], pa.large_string())])
        counts = np.concatenate([np.diff(cut.offsets.to_numpy()), np.array([len(row) for row in other], np.int64)])
        starts = np.cumsum(counts) - counts
        later = np.ones(len(flat), bool)
        later[starts] = False
        named = flat.filter(pa.array(later)).dictionary_encode()
        words, store = named.dictionary.to_numpy(zero_copy_only=False).tolist(), self.later
        if self.plain is not None:  # what is stored is the same for both cases
            words = [w.lower() if w.isascii() else w for w in words]
        pieces = list(map(store.get, words))
        missing = [k for k, x in enumerate(pieces) if x is None]
        full = len(store) > self.kept
        for k, ids in zip(missing, self._encoded([words[k] for k in missing])):
            pieces[k] = ids
            if not full and len(words[k]) <= KEPT_CHARS:
                store[words[k]] = ids
        # the first chunk of a text has no space before it
        heads = self._single(flat.take(pa.array(starts)).to_pylist())
        chosen = np.empty(len(flat), np.int64)
        chosen[later] = named.indices.to_numpy()
        chosen[starts] = len(pieces) + np.arange(len(heads))
        pieces += heads
        ids = np.frombuffer(b"".join(pieces), self.kind)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // ids.itemsize
        places = np.cumsum(sizes) - sizes
        lengths = sizes[chosen]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        joined = np.empty(int(ends[-1]), self.kind)
        for lo in range(0, len(chosen), STEP):
            hi = min(lo + STEP, len(chosen))
            at, n = ends[lo:hi], lengths[lo:hi]
            joined[ends[lo]:ends[hi]] = ids[np.arange(ends[lo], ends[hi]) + np.repeat(places[chosen[lo:hi]] - at, n)]
        out: list[bytes] = [b""] * len(texts)
        for (k, _), first, n in zip([*plain, *some], starts.tolist(), counts.tolist()):
            out[k] = joined[ends[first]:ends[first + n]].tobytes()
        return out


_made: dict[tuple[str, str, int | None], ChunkIds] = {}


def chunk_ids(path: str, kind: str = "<u4", kept: int | None = None) -> ChunkIds:
    """One for each worker process, file, type and number of kept chunks."""
    if (path, kind, kept) not in _made:
        _made[path, kind, kept] = ChunkIds(path, kind, kept)
    return _made[path, kind, kept]
