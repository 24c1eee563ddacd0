"""SentencePiece encoding and decoding: one pass of Viterbi over an Aho-Corasick automaton.

The automaton holds every normal piece. It reads a text once; at each place its output links give the
pieces that end there, each of which is relaxed from its start. A character without a piece of its own falls back on its
bytes.

For a unigram model a place keeps the best score, and the path with the largest sum of scores is the encoding; of equal
paths the one whose last piece is longer wins.

A BPE model's scores are minus the rank of its merges, so their sum means nothing: from single characters on, the two
neighbours whose joint piece has the best score are merged, the first of equals, until no two make a piece. What
that gives is one path, told by its neighbours: two pieces follow one another in it just if merging their two texts
together gives the two again, that is if no merge across their border comes before those which make them. So a piece is
relaxed only from a start whose last piece it fits (:meth:`MergeCodec.fits`). One piece fits at each place, and
the path is the library's encoding.

Spaces become U+2581 and one is put before the text. No piece of the supported models goes on after a
space that follows another character, nor holds a line feed (checked on loading), so the text is cut
there without changing the pieces, and the ids of parts are kept for later texts, in a table of
bounded size. Decoding gives back every text exactly: U+2581 itself goes by its bytes (the library takes it for a space).

Documents stay where they are: no shuffle. Defined cases: null and empty texts have no ids and decode to
an empty text; an empty table gives an empty table; further columns are kept, but for those
named as the results.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from . import arrays
from .common import small_batches

#: Bytes of parts and ids kept for later texts by each of a worker's two tables, and bytes of text taken at a time.
CACHE = 96 << 20
SLICE = 1 << 20
#: Pairs of pieces of which a worker remembers whether they fit.
FITS = 100_000
SPACE = "▁"
#: Stands for U+2581 inside a text while spaces stand as U+2581; in no piece.
_MARK = "\x00"
_TAIL = string.punctuation


class _Known:
    """The ids of parts met before, in two generations of about ``CACHE`` / 2 bytes; what the younger did not meet is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, part: str) -> bytes | None:
        return self.young.get(part) or self.old.get(part)

    def rest(self) -> None:
        """Between tasks only the younger generation is held."""
        self.old = {}

    def learn(self, parts: set[str], make) -> None:
        if self.held > CACHE // 2:
            self.young, self.old, self.held = {}, self.young, 0
        for p in parts.difference(self.young):
            x = self.old.pop(p, None)
            if x is None:
                x = make(p, self)
            self.young[p] = x
            self.held += 180 + len(p) + len(x)  # with the two objects and their place in the table


class Codec:
    """Viterbi: the encoding of a unigram model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        out: list[bytes] = []
        self.scores: dict[str, tuple[int, float, int]] = {}
        self.byte_score = -1e9
        for i in range(len(model)):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_ids[b], self.byte_score = i, min(-1.0, model.get_score(i))
                out.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                out.append(b"")
            else:
                out.append(p.replace(SPACE, " ").encode())
                self.scores[p] = (len(p), model.get_score(i), i)
        self.automaton = ahocorasick.Automaton()
        for p, v in self.scores.items():
            self.automaton.add_word(p, v)
        self.automaton.make_automaton()
        cuts = all(SPACE not in p.lstrip(SPACE) for p in self.scores) and not any("\n" in p and len(p) > 1 or _MARK in p for p in self.scores)
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if cuts else r"(?s).+").findall
        self.cuts = cuts
        self.words, self.parts = _Known(), _Known()
        #: The pairs of characters that some piece has: no piece spans the border of any other pair.
        self.within = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.sizes = np.array([len(x) for x in out])
        self.flat = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes

    def viterbi(self, part: str) -> tuple[list[int], float]:
        """The best ids of a part and their score."""
        n = len(part)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        scores, at = self.scores, 0

        def fall_back(upto: int) -> None:
            nonlocal at
            while at < upto:  # places that no piece has reached so far fall back on bytes
                c = part[at]
                at += 1
                if c not in scores:
                    s = best[at - 1] + self.byte_score * len((SPACE if c == _MARK else c).encode("utf-8", "surrogatepass"))
                    if s > best[at]:
                        best[at], back[at] = s, (at - 1, -1)

        for end, (length, score, i) in self.automaton.iter(part):
            if end > at:
                fall_back(end)
            start = end + 1 - length
            s = best[start] + score
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (start, i)
        fall_back(n)
        ids: list[int] = []
        p = n
        while p:
            start, i = back[p]
            if i < 0:
                c = SPACE if part[start] == _MARK else part[start]
                ids += self.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist()[::-1]
            else:
                ids.append(i)
            p = start
        return ids[::-1], best[n]

    def part(self, part: str) -> list[int]:
        """The ids of a part that no piece reaches beyond."""
        return self.viterbi(part)[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, worked out for some ``SLICE`` bytes of texts at a time."""
        out: list[np.ndarray] = []
        ends = np.cumsum([len(t or "") for t in texts])
        while len(out) < len(texts):
            upto = int(np.searchsorted(ends, (ends[len(out) - 1] if out else 0) + SLICE, "right"))
            out += self._encode_some(texts[len(out) : max(upto, len(out) + 1)])
        return out

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        plain: list[tuple[int, list[str]]] = []
        spaced: list[tuple[int, list[str]]] = []
        out = [np.zeros(0, dtype=np.int32)] * len(texts)
        for i, t in enumerate(texts):
            if not t:
                continue
            if _MARK in t:
                out[i] = self._rare(t)
            elif self.cuts and "  " not in t and t[0] != " " and SPACE not in t:
                plain.append((i, t.replace("\n", " \n").split(" ")))
            else:
                spaced.append((i, self.split((" " + t.replace(SPACE, _MARK)).replace(" ", SPACE))))
        for known, found, make in ((self.words, plain, self._word), (self.parts, spaced, lambda p, _: array("i", self.part(p)).tobytes())):
            known.learn(set().union(*(p for _, p in found)), make)
            for i, p in found:
                out[i] = np.frombuffer(b"".join(map(known.young.__getitem__, p)), dtype=np.int32)
        return out

    def rest(self) -> None:
        self.words.rest()
        self.parts.rest()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def _word(self, word: str, known: _Known) -> bytes:
        """The ids of what stands between two spaces, a line feed only being its first character.

        Punctuation at its end is parted from a word that is known, where no piece spans the border."""
        if word[:1] == "\n":
            ids = self.part("\n") + self.part(word[1:])
        else:
            n = len(word.rstrip(_TAIL))
            if 0 < n < len(word) and word[n - 1 : n + 1] not in self.within and (stem := known.get(word[:n])):
                return stem + array("i", self.part(word[n:])).tobytes()
            ids = self.part(SPACE + word)
        return array("i", ids).tobytes()

    def _rare(self, text: str) -> np.ndarray:
        """A text with the character that marks U+2581: it is cut there, and goes by its byte."""
        out, first = [], True
        for part in re.split(f"({_MARK})", text):
            if part == _MARK:
                if first:
                    out += self.part(SPACE)
                out.append(int(self.byte_ids[0]))
            elif part:
                marked = part.replace(SPACE, _MARK).replace(" ", SPACE)
                for p in self.split(SPACE + marked if first else marked):
                    out += self.part(p)
            else:
                continue
            first = False
        return np.array(out, dtype=np.int32)

    def decode(self, ids) -> bytes:
        """The bytes of the text that has these ids."""
        ids = np.asarray(ids, dtype=np.int64)
        n = self.sizes[ids]
        stops = np.cumsum(n)
        at = np.repeat(self.places[ids] - (stops - n), n) + np.arange(int(stops[-1]) if len(ids) else 0)
        return self.flat[at].tobytes()[1:]


class MergeCodec(Codec):
    """The encoding of a BPE model: pieces are relaxed where they fit the piece before."""

    def __init__(self, path: str):
        super().__init__(path)
        #: When a piece is merged: the smaller, the earlier. No piece is there before its parts.
        self.rank = {p: -score for p, (_, score, _) in self.scores.items()}
        #: The pieces that a piece's first or last character belongs to in turn, and when each is merged on.
        self.first: dict[str, tuple[tuple[str, float], ...]] = {}
        self.last: dict[str, tuple[tuple[str, float], ...]] = {}
        made: dict[str, float] = {}
        for p in sorted(self.rank, key=len):
            if len(p) > 1:
                parts = self._halves(p)
                if len(parts) != 2 or any(len(x) > 1 and x not in made for x in parts):
                    continue  # merges never give it
                for x in parts:
                    if len(x) == 1:
                        self.first[x] = self.last[x] = ((x, np.inf),)
                left, right = parts
                made[p] = max(self.rank[p], made.get(left, -np.inf), made.get(right, -np.inf))
                self.first[p] = (*self.first[left][:-1], (left, made[p]), (p, np.inf))
                self.last[p] = (*self.last[right][:-1], (right, made[p]), (p, np.inf))
            else:
                self.first[p] = self.last[p] = ((p, np.inf),)
        self.normal = [p for p in self.first if p in self.scores]
        self.token = [self.scores[p][2] for p in self.normal]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.normal):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.normal]
        self.known_fits: dict[int, bool] = {}

    def _halves(self, p: str) -> list[str]:
        """What is left of a piece's characters before the last merge; more than two where merges don't reach it."""
        s, get = list(p), self.rank.get
        while len(s) > 2:
            ranks = [get(a + b, np.inf) for a, b in zip(s, s[1:])]
            least = min(ranks)
            if least == np.inf:
                break
            i = ranks.index(least)
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def fits(self, a: str, b: str) -> bool:
        """Whether no merge across the border of two pieces comes before those that make them.

        Both grow at the border step by step. Of equal ranks the left one is first."""
        x, y, i, j = self.last[a], self.first[b], 0, 0
        while True:
            (u, until), (v, upto) = x[i], y[j]
            across = self.rank.get(u + v)
            if across is not None and across < until and across <= upto:
                return False
            if until == upto == np.inf:
                return True
            if until <= upto:
                i += 1
            else:
                j += 1

    def part(self, part: str) -> list[int]:
        if len(self.known_fits) > FITS:
            self.known_fits.clear()
        known, normal, length, n = self.known_fits, self.normal, self.length, len(self.normal)
        last = [-1] * (len(part) + 1)  # the last piece of the text up to each place; below 0 a character without a piece
        reached = -1
        for end, piece in self.automaton.iter(part):
            if end == reached:
                continue
            start = end + 1 - length[piece]
            if start:
                before = last[start]
                if before >= 0:
                    pair = before * n + piece
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.fits(normal[before], normal[piece])
                    if not fits:
                        continue
            last[end + 1] = piece
            reached = end
        ids: list[int] = []
        at = len(part)
        while at:
            i = last[at]
            if i >= 0:
                ids.append(self.token[i])
                at -= length[i]
            else:
                at -= 1
                c = SPACE if part[at] == _MARK else part[at]
                ids += self.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist()[::-1]
        ids.reverse()
        return ids


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """The codec that the kind of the model asks for."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = model.trainer_spec.model_type
    if kind not in (model.trainer_spec.UNIGRAM, model.trainer_spec.BPE):
        raise ValueError("only unigram and BPE models are supported")
    if kind == model.trainer_spec.UNIGRAM:
        return Codec(path)
    if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
        raise ValueError("BPE models with user-defined or unused pieces are not supported")
    return MergeCodec(path)


_VERIFIED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]


def _lists(ids: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The ids of a batch as one Arrow column of lists, and their numbers."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat), pa.array(sizes)


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) and n_tokens (long)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in arrays.small(batches, names.index(text)):
            yield pa.RecordBatch.from_arrays([*b.columns, *_lists(c.encode_all(b.column(names.index(text)).to_pylist()))], [*names, "ids", "n_tokens"])
        c.rest()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded (binary): the UTF-8 bytes that the ids stand for."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            col = b.column(names.index(ids))
            flat, stops = col.flatten().to_numpy(), np.cumsum(np.append(0, [x or 0 for x in pc.list_value_length(col).to_pylist()])).astype(np.int64)
            texts = [c.decode(flat[x:y]) for x, y in zip(stops[:-1], stops[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def verified(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int), n_tokens (long), and, of these ids decoded, decoded_sha256 (of the bytes) and
    round_trip (whether they are the text's). One worker does both, and the decoded text goes no further."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(f.name for f in _VERIFIED))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in arrays.small(batches, names.index(text)):
            texts = b.column(names.index(text)).to_pylist()
            ids = c.encode_all(texts)
            back = [c.decode(x) for x in ids]
            shas = [hashlib.sha256(x).hexdigest() for x in back]
            same = [x == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(back, texts)]
            lists, sizes = _lists(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, sizes, pa.array(shas, pa.string()), pa.array(same, pa.bool_())], [*names, *(f.name for f in _VERIFIED)])
        c.rest()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_VERIFIED]))


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verified(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "decoded_sha256", "round_trip", "ids")
