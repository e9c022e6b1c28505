"""Alignment of two tokenizers over the same texts by merge-path partitioning.

Both tokenizers cut the same bytes, so the alignment is the merge of two ascending lists of token ends.
The tokens of consecutive documents are laid end to end (the end of a document is an end of both sides)
and the merge is divided by its diagonals: a binary search on diagonal d tells how many of the first d
merged ends belong to either side. The pieces between two diagonals hold equally many ends, whether they
are hundreds of short documents or a part of a long one, and each is worked off by itself: from its own
ends and one token of either neighbour it emits the overlaps and the groups that close in it. A document
that reaches over the border of a piece leaves an open group there; those few parts are brought together
and stitched.

How often a pair of ids is linked is counted over the whole corpus: every piece sends each of its pairs
once with its number, the counts come back to the pieces that asked, and the documents of a piece look
their pairs up there. So no link travels by itself, a pair that stands in every document is summed
before it is sent, and what a task holds is bounded by the size of a piece.

A text that is null or empty, or whose tokens do not give back its bytes on both sides, has no tokens.
Repeated rows are aligned and counted each for itself, also with one doc_id; ties cannot occur, as a
tokenizer has one answer. An empty table gives an empty result. Other columns are neither read nor
carried. A single text is encoded in one task, however long it is; its merge is cut like any other.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import landed, table

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Merged ends of a piece.
PIECE = 1 << 18
#: Bytes of text encoded at once, and bytes whose tokens are laid end to end and cut into pieces.
ENCODED = 1 << 18
LAID = 1 << 20
#: Pairs in a row of the table of pieces. Spark reads thousands of rows of a table at once, so rows are small.
LISTED = 512

#: Letters, digits and signs that every version of Unicode classes alike. Texts of them are cut in the same
#: way by either of the two libraries that know the first vocabulary; the faster one takes these.
SETTLED = re.compile(
    "[\x00-\u0233\u0250-\u02ad\u0388-\u038a\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048c-\u04c4"
    "\u2010-\u2027\u2030-\u2046\u20a0-\u20ac\u3001-\u3029\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
)
#: How byte-level vocabularies cut a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DOCS = pa.struct(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()),
        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups", pa.string()), ("first_a", pa.string()), ("first_b", pa.string()), ("last_a", pa.string()),
        ("last_b", pa.string()), ("pair_at", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int32())),
    ]
)
DOCS_DDL = (
    "row bigint, doc_id bigint, part int, whole boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups string, first_a string, first_b string, last_a string, last_b string, "
    "pair_at array<int>, pair_n array<int>"
)


# Tokens


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Both tokenizers and the bytes of every token."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for entry, i in self.a.get_vocab().items():
            known = all(c in letters for c in entry)
            self.bytes_a[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Every id in decimal, filled with zero bytes, and one place for the sign that follows it.
        count = max(len(self.bytes_a), len(self.bytes_b), 1)
        width = len(str(count - 1))
        self.decimal = np.zeros((count, width + 1), np.uint8)
        text = np.array([str(i).encode() for i in range(count)], f"S{width}")
        self.decimal[:, :width] = text.view(np.uint8).reshape(count, width)

        self.fast = self._fast(json.loads(a))

    def _fast(self, file: dict):
        """The first tokenizer by ranks, if the file is plain byte-level BPE whose ids are the ranks of its merges."""
        model, before = file["model"], file["pre_tokenizer"]
        plain = (
            file["normalizer"] is None
            and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and model["type"] == "BPE"
            and not any(model[x] for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]] if plain else []
        if not plain or any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
            return None
        import tiktoken

        special = {t["id"] for t in file["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("given", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where a side does not give the bytes back."""
        settled = [self.fast is not None and SETTLED.fullmatch(t) is not None for t in texts]
        others = iter(self.a.encode_batch([" " + t for t, s in zip(texts, settled) if not s], add_special_tokens=False))
        a = [self.fast.encode_ordinary(" " + t) if s else next(others).ids for t, s in zip(texts, settled)]
        b = self.b.encode(texts, num_threads=1)
        return [(x, y) if self._same(t, x, y) else ([], []) for t, x, y in zip(texts, a, b)]

    def _same(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        wanted = b" " + text.encode("utf-8", "surrogatepass")
        joined = (b"".join(map(table.__getitem__, ids)) for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        return all(x == wanted for x in joined)


@lru_cache(maxsize=2)
def _codec(a: bytes, b: bytes) -> Codec:
    return Codec(a, b)


# Merging


@dataclass
class Laid:
    """Tokens of several documents end to end; ``*_from[d]`` is the first token of document d."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    doc_ends: np.ndarray

    @classmethod
    def of(cls, encoded: list[tuple[list[int], list[int]]], codec: Codec) -> Laid:
        a_from = np.cumsum([0] + [len(a) for a, _ in encoded])
        b_from = np.cumsum([0] + [len(b) for _, b in encoded])
        ids_a = np.fromiter(chain.from_iterable(a for a, _ in encoded), np.int32, a_from[-1])
        ids_b = np.fromiter(chain.from_iterable(b for _, b in encoded), np.int32, b_from[-1])
        ends_a, ends_b = np.cumsum(codec.size_a[ids_a]), np.cumsum(codec.size_b[ids_b])
        doc_ends = np.concatenate(([0], ends_a))[a_from[1:]]
        return cls(ids_a, ids_b, ends_a, ends_b, a_from, b_from, doc_ends)


def diagonal(a: np.ndarray, b: np.ndarray, d: int) -> tuple[int, int]:
    """How many of the first ``d`` ends of the merge come from either side; equal ends: first a, then b."""
    low, high = max(0, d - len(b)), min(d, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[d - i - 1]:
            low = i + 1
        else:
            high = i
    return low, d - low


def cuts(laid: Laid, piece: int) -> list[tuple[int, int]]:
    """Borders of pieces of equal work, as (tokens of a, tokens of b) before each."""
    steps = len(laid.ends_a) + len(laid.ends_b)
    count = max(1, -(-steps // piece))
    return [diagonal(laid.ends_a, laid.ends_b, steps * k // count) for k in range(count + 1)]


@dataclass
class Merged:
    """What one piece finds: links as token positions, ends that close a group, groups of its tokens."""

    link_a: np.ndarray
    link_b: np.ndarray
    link_end: np.ndarray
    closes: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def merge(laid: Laid, begin: tuple[int, int], end: tuple[int, int]) -> Merged:
    """Overlaps and closing ends between two borders; looks at one token beyond either of them."""
    (i0, j0), (i1, j1) = begin, end
    a, b = laid.ends_a[i0:i1], laid.ends_b[j0:j1]
    # An end of a belongs to the token of b that ends there or is the next to end.
    over_a = j0 + np.searchsorted(laid.ends_b[j0 : j1 + 1], a, "left")
    before = np.searchsorted(a, b, "right")
    last = np.concatenate(([laid.ends_a[i0 - 1] if i0 else -1], a))[before]
    common = last == b
    closes = b[common]
    return Merged(
        np.concatenate([np.arange(i0, i1), i0 + before[~common]]),
        np.concatenate([over_a, j0 + np.flatnonzero(~common)]),
        np.concatenate([a, b[~common]]),
        closes,
        np.searchsorted(closes, a, "left"),
        np.searchsorted(closes, b, "left"),
    )


def _written(codec: Codec, laid: Laid, m: Merged, begin, end) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The tokens of a piece as ``a1,a2|b1;``, where each token begins in it, and the group of each token."""
    (i0, j0), (i1, j1) = begin, end
    place_a = np.arange(i1 - i0) + np.searchsorted(m.group_b, m.group_a, "left")
    place_b = np.arange(j1 - j0) + np.searchsorted(m.group_a, m.group_b, "right")
    n = (i1 - i0) + (j1 - j0)
    ids, group, side = np.empty(n, np.int32), np.empty(n, np.int64), np.zeros(n, np.int8)
    ids[place_a], ids[place_b] = laid.ids_a[i0:i1], laid.ids_b[j0:j1]
    group[place_a], group[place_b] = m.group_a, m.group_b
    side[place_b] = 1
    signs = codec.decimal[ids]
    if n:
        signs[:, -1] = ord(";")
        same = group[1:] == group[:-1]
        signs[:-1, -1][same] = np.where(side[1:] == side[:-1], ord(","), ord("|"))[same]
    begins = np.concatenate(([0], np.cumsum((signs != 0).sum(1))))
    flat = signs.ravel()
    return flat[flat != 0].tobytes(), begins, group


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _documents_of(codec: Codec, laid: Laid, no: int, begin, end, rows: list[int], doc_ids: list) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The documents that a piece holds, whole or in part, and its pairs of ids with their numbers."""
    (i0, j0), (i1, j1) = begin, end
    m = merge(laid, begin, end)
    code = laid.ids_a[m.link_a].astype(np.int64) * len(codec.bytes_b) + laid.ids_b[m.link_b]
    pairs, at = np.unique(code, return_inverse=True)
    doc_of_link = np.searchsorted(laid.doc_ends, m.link_end, "left")
    each, times = np.unique(doc_of_link * max(len(pairs), 1) + at, return_counts=True)
    text, begins, group = _written(codec, laid, m, begin, end)
    out = []
    ends = np.concatenate([laid.ends_a[i0:i1], laid.ends_b[j0:j1]])
    if not len(ends):
        return out, pairs, np.zeros(0, np.int64)
    first, last = np.searchsorted(laid.doc_ends, [ends.min(), ends.max()], "left").tolist()
    for d in range(first, last + 1):
        a0, a1 = (max(int(x), i0) for x in laid.a_from[d : d + 2])
        b0, b1 = (max(int(x), j0) for x in laid.b_from[d : d + 2])
        a1, b1 = min(a1, i1), min(b1, j1)
        if a1 <= a0 and b1 <= b0:
            continue
        tokens = laid.a_from[d + 1] - laid.a_from[d] + laid.b_from[d + 1] - laid.b_from[d]
        start = laid.doc_ends[d - 1] if d else 0
        g0, g1 = np.searchsorted(m.closes, [start, laid.doc_ends[d]], "right").tolist()
        p0, p1 = np.searchsorted(each, [d * len(pairs), (d + 1) * len(pairs)])
        row = {
            "row": rows[d], "doc_id": doc_ids[d], "part": no, "whole": bool((a1 - a0) + (b1 - b0) == tokens),
            "n_a": max(a1 - a0, 0), "n_b": max(b1 - b0, 0), "n_groups": g1 - g0,
            "n_links": int(times[p0:p1].sum()),
            "groups": None, "first_a": None, "first_b": None, "last_a": None, "last_b": None,
            "pair_at": (each[p0:p1] - d * len(pairs)).astype(np.int32), "pair_n": times[p0:p1].astype(np.int32),
        }
        # Places of the tokens of this document, in the order they are written.
        t0, t1 = (a0 - i0) + (b0 - j0), (a1 - i0) + (b1 - j0)
        if row["whole"]:
            row["groups"] = hashlib.sha256(text[begins[t0] : begins[t1] - 1]).hexdigest()
        else:
            in_a, in_b = m.group_a[a0 - i0 : a1 - i0], m.group_b[b0 - j0 : b1 - j0]
            ids_a, ids_b = laid.ids_a[a0:a1], laid.ids_b[b0:b1]
            if g1 > g0:
                row["first_a"], row["first_b"] = _listed(ids_a[in_a == g0]), _listed(ids_b[in_b == g0])
                inner = t0 + np.searchsorted(group[t0:t1], [g0 + 1, g1], "left")
                row["groups"] = text[begins[inner[0]] : max(begins[inner[0]], begins[inner[1]] - 1)].decode()
            row["last_a"], row["last_b"] = _listed(ids_a[in_a == g1]), _listed(ids_b[in_b == g1])
        out.append(row)
    return out, pairs, np.bincount(at, minlength=len(pairs))


def _without_tokens(row: int, doc_id) -> dict:
    return {
        "row": row, "doc_id": doc_id, "part": 0, "whole": True, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0,
        "groups": "", "first_a": None, "first_b": None, "last_a": None, "last_b": None, "pair_at": [], "pair_n": [],
    }


def _in_rows(doc: dict, most: int) -> Iterator[dict]:
    """A document of a piece with at most ``most`` of its pairs a row; ``whole`` is null in all rows but the first."""
    for i in range(0, max(len(doc["pair_at"]), 1), most):
        row = doc | {"pair_at": doc["pair_at"][i : i + most], "pair_n": doc["pair_n"][i : i + most]}
        yield row | {"whole": None, "groups": None} if i else row


# Spark


def _slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive rows of about ``limit`` bytes, one at least."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _laid_out(batches: Iterator[pa.RecordBatch], codec: Codec):
    """(tokens end to end, row numbers, doc_ids, row numbers and doc_ids of texts without tokens)."""
    made = TaskContext.get().partitionId() << 40
    for batch in batches:
        text = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        for part in _slices(sizes, LAID):
            doc_ids = batch.column("doc_id").slice(part.start, part.stop - part.start).to_pylist()
            rows = [made + i for i in range(len(doc_ids))]
            made += len(doc_ids)
            encoded = []
            for few in _slices(sizes[part], ENCODED):
                texts = text.slice(part.start + few.start, few.stop - few.start).to_pylist()
                found = iter(codec.encode([t for t in texts if t]))
                encoded += [next(found) if t else ([], []) for t in texts]
            live = [i for i, (a, _) in enumerate(encoded) if a]
            dead = [i for i, (a, _) in enumerate(encoded) if not a]
            laid = Laid.of([encoded[i] for i in live], codec)
            yield laid, [rows[i] for i in live], [doc_ids[i] for i in live], [(rows[i], doc_ids[i]) for i in dead]


def _files(spark: SparkSession, *paths: str):
    """The vocabularies, read once by the driver; some megabytes, whatever the corpus."""
    found = []
    for path in paths:
        with open(path, "rb") as f:
            found.append(f.read())
    return spark.sparkContext.broadcast(tuple(found))


def _input(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def overlaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, piece: int = PIECE
) -> DataFrame:
    """One row per link: row, doc_id, positions and ids of both tokens, byte range, whether a group closes there.

    ``row`` tells apart rows with one doc_id. Bytes count from the blank that stands before each text.
    """
    sent = _files(docs.sparkSession, a, b)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for laid, rows, doc_ids, _ in _laid_out(batches, codec):
            borders = cuts(laid, piece)
            for begin, end in zip(borders, borders[1:]):
                m = merge(laid, begin, end)
                if not len(m.link_end):
                    continue
                doc = np.searchsorted(laid.doc_ends, m.link_end, "left")
                start_a = laid.ends_a[m.link_a] - codec.size_a[laid.ids_a[m.link_a]]
                start_b = laid.ends_b[m.link_b] - codec.size_b[laid.ids_b[m.link_b]]
                zero = np.concatenate(([0], laid.doc_ends))[doc]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": np.array(rows)[doc],
                        "doc_id": pa.array([doc_ids[d] for d in doc], pa.int64()),
                        "a": (m.link_a - laid.a_from[doc]).astype(np.int32),
                        "b": (m.link_b - laid.b_from[doc]).astype(np.int32),
                        "a_id": laid.ids_a[m.link_a],
                        "b_id": laid.ids_b[m.link_b],
                        "start": np.maximum(start_a, start_b) - zero,
                        "end": m.link_end - zero,
                        "closes": np.isin(m.link_end, laid.ends_b) & np.isin(m.link_end, laid.ends_a),
                    }
                )

    schema = "row bigint, doc_id bigint, a int, b int, a_id int, b_id int, start bigint, end bigint, closes boolean"
    return _input(docs, key, text).mapInArrow(emit, schema)


def _worked_pieces(docs: DataFrame, key: str, text: str, a: str, b: str, piece: int) -> DataFrame:
    """Rows of a piece: its pairs of ids with their numbers, so many a row from place ``at`` on, and the documents in it."""
    sent = _files(docs.sparkSession, a, b)
    fields = pa.schema(
        [("piece", pa.int64()), ("at", pa.int32()), ("pair", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64())), ("doc", DOCS)]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        name = TaskContext.get().partitionId() << 40
        for laid, rows, doc_ids, dead in _laid_out(batches, codec):
            borders = cuts(laid, piece)
            for no, (begin, end) in enumerate(zip(borders, borders[1:])):
                found, pairs, times = _documents_of(codec, laid, no, begin, end, rows, doc_ids)
                if no == 0:
                    found += [_without_tokens(*x) for x in dead]
                made = [
                    {"piece": name, "at": i, "pair": pairs[i : i + LISTED], "pair_n": times[i : i + LISTED]}
                    for i in range(0, len(pairs), LISTED)
                ]
                made += [{"piece": name, "doc": row} for doc in found for row in _in_rows(doc, LISTED)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=fields)
                name += 1

    schema = f"piece bigint, at int, pair array<bigint>, pair_n array<bigint>, doc struct<{DOCS_DDL.replace(' ', ':').replace(',:', ',')}>"
    return _input(docs, key, text).mapInArrow(work, schema)


def _looked_up(parts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The documents of one piece with the sums over their links."""
    size = int(known["at"].max()) + 1 if len(known) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[known["at"]] = known["total"]
    best[known["at"]] = known["best"]
    out = parts.drop(columns=["piece", "pair_at", "pair_n"])
    at, n = parts["pair_at"], parts["pair_n"]
    out["n_best"] = [int((best[i] * k).sum()) for i, k in zip(at, n)]
    out["count_sum"] = [int((count[i] * k.astype(np.int64)).sum()) for i, k in zip(at, n)]
    first = out["whole"].notna()
    if not first.all():
        sums = ["n_best", "count_sum"]
        out[sums] = out.groupby(["row", "part"])[sums].transform("sum")
        out = out[first].astype({"whole": bool})
    return out


def _stitched(parts: pd.DataFrame) -> pd.DataFrame:
    """One document out of its parts: groups that were open at a border are closed by the parts behind it."""
    parts = parts.sort_values("part")
    digest, lead = hashlib.sha256(), b""
    open_a: list[str] = []
    open_b: list[str] = []
    for p in parts.itertuples(index=False):
        if p.n_groups:
            closed = [",".join(x for x in [*open_a, p.first_a] if x) + "|" + ",".join(x for x in [*open_b, p.first_b] if x)]
            if p.groups:
                closed.append(p.groups)
            digest.update(lead + ";".join(closed).encode())
            open_a, open_b, lead = [], [], b";"
        open_a.append(p.last_a)
        open_b.append(p.last_b)
    sums = {c: [int(parts[c].sum())] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    return pd.DataFrame({"doc_id": parts["doc_id"].iloc[:1], **sums, "groups_sha256": [digest.hexdigest()]})


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, piece: int = PIECE
) -> DataFrame:
    """Per document: tokens, groups and links, how usual its links are in the corpus, digest of its groups.

    ``n_best`` counts links whose pair of ids is the most frequent of its b id, ``count_sum`` adds up how
    often the pair of each link is linked in the corpus.
    """
    worked = landed(_worked_pieces(docs, key, text, a, b, piece), "aligned-pieces")
    width = len(_codec(*_files(docs.sparkSession, a, b).value).bytes_b)
    asked = worked.where("doc IS NULL").select("piece", "at", F.posexplode(F.arrays_zip("pair", "pair_n")).alias("i", "x")).select(
        "piece", (F.col("at") + F.col("i")).alias("at"), F.col("x.pair").alias("pair"), F.col("x.pair_n").alias("n")
    )
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair") % width)
    # At most one row per id of the second vocabulary.
    top = totals.groupBy("b_id").agg(F.max("total").alias("most"))
    known = totals.join(F.broadcast(top), "b_id").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))
    answers = asked.join(known, "pair").select(F.col("piece").alias("asking"), "at", "total", "best")
    parts = worked.where("doc IS NOT NULL").select("piece", "doc.*")
    kept = DOCS_DDL.replace(", pair_at array<int>, pair_n array<int>", ", n_best bigint, count_sum bigint")
    summed = landed(
        parts.groupBy("piece").cogroup(answers.groupBy("asking")).applyInPandas(_looked_up, kept), "aligned-parts"
    )
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    whole = summed.where("whole").withColumn("groups_sha256", F.col("groups")).select(*out)
    return whole.unionByName(summed.where("NOT whole").groupBy("row").applyInPandas(_stitched, schema))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over every document."""
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE: dict[str, str] = {}
