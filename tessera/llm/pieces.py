"""SentencePiece encoding and decoding: a batched numpy Viterbi over equal-length words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.portions import by_length, slices

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: What a character without a piece costs below the lowest score, as the format's lattices have it.
UNKNOWN_PENALTY = 10.0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the tables of pairs and of hashes.
PAIR_BITS, SEEN_BITS = 20, 22
#: Longer words are cut where no piece crosses; letters of words that are taken at a time.
LONG, LETTERS = 64, 100_000


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces with scores and types, and whether it is of the merging (BPE) kind."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    merges: bool
    dummy_prefix: bool


def load(path: str) -> Model:
    """Read a model file. Kinds other than unigram and BPE, character maps and special pieces that need other rules
    are refused rather than encoded wrongly."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    proto = format_.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind not in (1, 2) or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only unigram and BPE models without a character map are supported")
    if {p.type for p in proto.pieces} - {1, 2, 3, 6} or not proto.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: user-defined and unused pieces, and models without byte pieces, are not supported")
    return Model(
        tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), tuple(p.type for p in proto.pieces), kind == 2,
        normal.add_dummy_prefix
    )


class Coder:
    """Encodes and decodes with one model.

    For a unigram model a word's path is the one of the highest summed score. For a BPE model it is the one whose
    neighbouring pieces all agree, that is, merging the two pieces' characters gives the same two pieces: no merge
    crosses their border, so such a path is what merging the whole word gives, and there is exactly one.
    """

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.raw = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.past = {i: self.history(p) for p, i in self.ids.items()} if model.merges else {}
        # a piece that merging never makes is no piece of any path
        usable = {p: i for p, i in self.ids.items() if not model.merges or self.past[i][-1][1] == p}
        self.least = min(model.scores[i] for i in self.ids.values())
        self.longest = max(map(len, self.ids))
        keys = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in usable])
        order = np.argsort(keys)
        self.keys, self.at = keys[order], np.fromiter(usable.values(), np.int64)[order]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
        self.scores = np.array(model.scores)
        self.letters = np.full((len(model.pieces), self.longest), -1, np.int32)
        for p, i in self.ids.items():
            self.letters[i, : len(p)] = [ord(c) for c in p]
        self.sizes = (self.letters >= 0).sum(axis=1)
        self.inner = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)} or {-1}), np.int64)
        known = {c for p in self.ids for c in p}
        # a border where no piece can lie across: before a run of spaces, and around a newline that no piece holds
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "" if "\n" in known else "\n"
        self.word = re.compile(f"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.words: dict[str, bytes] = {}
        self.codes, self.verdicts = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.out = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.raw.items():
            self.out[i] = bytes([b])
        for i, t in enumerate(model.types):
            if t not in (NORMAL, BYTE):
                self.out[i] = b"" if t != UNKNOWN else " ⁇ ".encode()

    @staticmethod
    def _hash(letters: np.ndarray) -> np.ndarray:
        h = np.zeros(len(letters), np.uint64)
        for column in letters.T:
            h = h * FACTOR + column + np.uint64(1)
        return h

    def history(self, text: str) -> list[tuple[float, str, str]]:
        """What merging a text's characters does: each merge's score, and the first and last symbol after it.

        Neighbours are merged, always the pair of the highest score, of equal ones the leftmost.
        """
        s, done = list(text), [(0.0, text[0], text[-1])]
        own = self.model.pieces  # the pieces' own strings and scores are kept, not copies
        while True:
            scored = [(-self.model.scores[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.ids]
            if not scored:
                return done
            i = min(scored)[1]
            piece = self.ids[s[i] + s[i + 1]]
            s[i : i + 2] = [own[piece]]
            done.append((self.model.scores[piece], s[0], s[-1]))

    def apart_still(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        """Whether no merge crosses the border of two texts when both are merged side by side.

        At any time the best merge is the next one within the left, the next within the right, or the one across; the
        left wins ties, as it lies before the border, and the one across wins over the right.
        """
        i = j = 0
        while True:
            across = self.ids.get(left[i][2] + right[j][1])
            next_left = left[i + 1][0] if i + 1 < len(left) else -np.inf
            next_right = right[j + 1][0] if j + 1 < len(right) else -np.inf
            if across is not None and self.model.scores[across] > next_left and self.model.scores[across] >= next_right:
                return False
            if next_left == next_right == -np.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces stay as they are when their characters are merged.

        Verdicts are kept in a table of fixed size with one place per hash; what another pair took is found again.
        """
        codes = left * len(self.scores) + right
        place = (codes.astype(np.uint64) * FACTOR >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.verdicts[place]
        missing = np.flatnonzero(self.codes[place] != codes)
        if len(missing):
            new, back = np.unique(codes[missing], return_inverse=True)
            found = np.array([self.apart_still(self.past[a], self.past[b]) for a, b in zip(*(x.tolist() for x in divmod(new, len(self.scores))), strict=True)])
            out[missing] = found[back]
            self.codes[place[missing]] = codes[missing]
            # of pairs with one place the last stays: its verdict is read back by the code that is there
            self.verdicts[place[missing]] = out[missing]
        return out

    def found(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place in words of one length where a piece lies, or a character without one (id -1): ends, rows,
        lengths and ids, by end and then by length. All substrings of a length are hashed and probed together."""
        n, size = letters.shape
        units, hashes, parts = letters.astype(np.uint64) + np.uint64(1), None, []
        for k in range(1, min(size, self.longest) + 1):
            hashes = units if hashes is None else hashes[:, :-1] * FACTOR + units[:, k - 1 :]
            # most substrings are no piece: a table of leading bits tells before the sorted keys are searched
            rows, starts = np.nonzero(self.seen[(hashes >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
            own = hashes[rows, starts]
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == own)
            rows, starts, ids = rows[hit], starts[hit], self.at[place[hit]]
            same = self.sizes[ids] == k
            for j in range(k):
                same &= self.letters[ids, j] == letters[rows, starts + j]
            rows, starts, ids = rows[same], starts[same], ids[same]
            if k == 1:
                alone = np.ones((n, size), bool)
                alone[rows, starts] = False
                lone = np.nonzero(alone)
                rows, starts, ids = np.concatenate([rows, lone[0]]), np.concatenate([starts, lone[1]]), np.concatenate([ids, np.full(len(lone[0]), -1)])
            parts.append((starts + k, rows, np.full(len(ids), k, np.int32), ids))
        ends, rows, lengths, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ends, kind="stable")
        return ends[order], rows[order], lengths[order], ids[order]

    def lattice(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, all moved on together a character at a time."""
        n, size = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32).reshape(n, size)
        ends, rows, lengths, ids = self.found(letters)
        bounds = np.searchsorted(ends, np.arange(size + 2)).tolist()
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        step, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int64)
        gains = np.zeros(len(ids)) if self.model.merges else np.where(ids >= 0, self.scores[ids], self.least - UNKNOWN_PENALTY)
        for i in range(1, size + 1):
            part = slice(bounds[i], bounds[i + 1])
            r, k, p = rows[part], lengths[part], ids[part]
            score = best[r, i - k] + gains[part]
            ok = score > -np.inf
            if self.model.merges:
                before = piece[r, i - k]
                pair = np.flatnonzero(ok & (before >= 0) & (p >= 0))
                if len(pair):
                    ok[pair] = self.agree(before[pair], p[pair])
                ok = np.flatnonzero(ok)
            else:
                np.maximum.at(best[:, i], r, score)
                # of equal sums the shortest piece stays: it is written last
                ok = np.flatnonzero(ok & (score == best[r, i]))[::-1]
            r = r[ok]
            best[r, i], step[r, i], piece[r, i] = score[ok], k[ok], p[ok]
        return self._walk(words, step, piece)

    def parts(self, word: str) -> list[str]:
        """A long word cut wherever two characters meet that stand together in no piece: neither a piece nor a merge
        crosses such a border, so the parts are encoded for themselves, and those of one length together."""
        if len(word) <= LONG:
            return [word]
        letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        codes = letters[:-1] << 21 | letters[1:]
        place = np.minimum(np.searchsorted(self.inner, codes), len(self.inner) - 1)
        cuts = (np.flatnonzero(self.inner[place] != codes) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _walk(self, words: list[str], step: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Follow the backpointers of all words together, from their ends; words with unknown characters by themselves."""
        if len(words) == 1:
            steps, ids, at, path = step[0].tolist(), piece[0].tolist(), len(words[0]), []
            while at:
                path.append(ids[at])
                at -= steps[at]
            found = np.array([path[::-1]], np.int32)
        else:
            rows, at = np.arange(len(words)), np.full(len(words), len(words[0]))
            columns = []
            while at.any():
                columns.append(np.where(at > 0, piece[rows, at], -2))
                at = at - np.where(at > 0, step[rows, at], 0)
            found = np.stack(columns[::-1], axis=1).astype(np.int32)
        start = (found == -2).argmin(axis=1)
        data, wide = found.tobytes(), 4 * found.shape[1]
        out = [data[r * wide + 4 * k : (r + 1) * wide] for r, k in enumerate(start.tolist())]
        for r in np.flatnonzero((found == -1).any(axis=1)).tolist():
            ids, place = [], 0
            for x in found[r, start[r] :].tolist():
                ids += [x] if x >= 0 else [self.raw[b] for b in words[r][place].encode("utf-8", "surrogatepass")]
                place += len(self.model.pieces[x]) if x >= 0 else 1
            out[r] = np.array(ids, np.int32).tobytes()
        return out

    def encode(self, texts: list[str], keep: int = 300_000) -> list[np.ndarray]:
        """The ids of each text; those of about ``keep`` words are remembered."""
        split = []
        for t in texts:
            t = t.replace(" ", SPACE)
            t = SPACE + t if self.model.dummy_prefix and t else t
            words = self.word.findall(t) if self.apart else [t] if t else []
            split.append([x for w in words for x in self.parts(w)] if max(map(len, words), default=0) > LONG else words)
        if len(self.words) > keep:
            self.words.clear()
        for group in by_length({w for ws in split for w in ws if w not in self.words}, LETTERS):
            self.words.update(zip(group, self.lattice(group), strict=True))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def coder(model: Model) -> Coder:
    return Coder(model)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: int = 300_000, portion: int = 2_000_000) -> DataFrame:
    """One row ``(doc_id, ids, n_ids, decoded)`` per document: the whole text's piece ids, and the text decoded from
    the ids again. A null or empty text has no ids and decodes to the empty text; a text of any length, with or without
    spaces, is encoded whole; of paths with equal sums the one with the shorter last piece is taken; repeated rows stay;
    an empty table gives no rows; other columns are not read. Text that holds the space mark U+2581 itself decodes to spaces there.
    The model, of a fixed size, is read on the driver and broadcast. A worker remembers ``keep`` words and takes
    ``portion`` bytes of text at a time: what it holds, not what it returns.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for b in slices(batches, 1, portion):
            ids = own.encode([t or "" for t in b.column(1).to_pylist()], keep)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array([own.decode(x.tolist()) for x in ids], pa.string())],
                ["doc_id", "ids", "n_ids", "decoded"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, decoded string").withColumnRenamed("doc_id", id_col)
