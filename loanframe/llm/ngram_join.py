"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of all n-grams, rare ones first, is cut at pivots into fragments. Each fragment joins its
own segment of the sets, and the partial overlaps it counts are summed per pair.

0. *Before.* Two sets of similarity t hold l common n-grams among the first n - ceil(t n) + l of each, in any
   order of all n-grams. These go ahead as 32-bit keys; a document of which too few occur again has no partner.
   The others are told from it by a bounded map of bits, so some more may stay, and no set without need.
1. *Counts.* N-grams of what stayed are counted in slices of their hash, which hand back, per document, the n-grams that
   occur elsewhere. An n-gram of one document overlaps with nothing, so a document with too few of the
   others is done. N-grams that stand in two documents of a bounded sample need no count: they are known to
   repeat, go last in the order, and keep very frequent n-grams out of the slices.
2. *Classes.* Let R be the n-grams of a document that repeat, and n the size of its set. Overlaps are
   overlaps of R, so documents with equal (R, n) link with the same others: they are one class. Between
   classes of one R a link depends on the sizes alone, ``100 |R| >= t (n + n' - |R|)``, so all that link
   at all link with the smallest. Documents that share a passage and little else cost no pairs.
3. *Candidates.* Two sets of similarity t share one of the first |R| - ceil(t n) + 1 n-grams of each. A
   class whose size fits no other holder of an n-gram, given that the overlap is at most |R| and |R'|,
   drops out there. Of the classes that share an n-gram one is a hub, all others are paired with the
   hub only, where sizes and |R| allow the similarity.
4. *Overlaps.* Fragment by fragment, summed per pair and compared with the union in whole numbers.
5. Linked classes become one component. Classes that share an n-gram and are in different components are
   paired with further hubs, many times as many per round and all where few are left, until each n-gram has
   one component or all its classes have been hubs: no link between components is left out, and a group of
   copies costs as many pairs as it has members. From here on a pair is formed only if its bits allow the
   similarity: each n-gram of R flips one bit, so sets differ in as many n-grams as bits at least.

N-grams are 64-bit hashes of lower-cased words (A-Z only). Fewer words than n make one n-gram of the whole
sequence; a null text or one without words has an empty set and links with nothing. Rows without a doc_id
link with nothing and have a null component. Rows that repeat a doc_id are one node: they share the
component of either text, each has its own count. Other columns are neither read nor carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import components, landed, small_batches, table
from loanframe.llm.wordhash import grams, mix, pieces, sequence, words

SIZE = 5
#: The similarity as a whole number of hundredths.
PERCENT = 75
#: Documents of the sample that puts frequent n-grams last.
SAMPLE_ROWS = 4000
#: N-grams meant for a slice of the counts, and keys for a slice of those that go ahead.
SLICE_ROWS = 400_000
KEY_ROWS = 2_000_000
#: Bits of the map of documents that stay: for each document, at least and at most.
MAP_BITS = (8, 1 << 16, 1 << 26)
#: Words of 64 bits that the n-grams of a class flip.
FLIPS = 16
#: Pivots of the order: fragments of n-grams in up to so many documents, and one of all more frequent ones.
PIVOTS = (2, 8, 64)
#: Classes of an n-gram that are all hubs at once, and times the hubs of larger ones grow from round to round.
ALL_HUBS = 48
HUB_GROWTH = 64
#: Text whose answers are put together in one group.
BUCKET_BYTES = 1 << 22

#: A piece is some documents of a batch. Per fragment: n-grams and the places of their documents (kind 0).
#: Back: per n-gram that repeats the document's place in the piece, and its count (kind 0). What is known
#: of the documents of a piece travels along (kind 1).
PACKED = "grp int, kind int, piece bigint, docs binary, sets binary, sizes binary, grams binary, counts binary"
FLIPPED = "struct<" + ", ".join(f"w{i}: bigint" for i in range(FLIPS)) + ">"


def _set_of(hashes: np.ndarray, size: int) -> np.ndarray:
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < size:
        return np.array([sequence(hashes)], np.uint64)
    return np.unique(grams(hashes, size))


def _sets(texts, size: int) -> list[np.ndarray]:
    out = []
    for part in pieces(texts):
        w = words(texts.iloc[part], lower=True)
        out += [_set_of(w.hashes[w.of(i)], size) for i in range(part.stop - part.start)]
    return out


def _name(grams_: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(sequence(grams_).view(np.int64)) if len(grams_) else 0


_COLUMNS = ["grp", "kind", "piece", "docs", "sets", "sizes", "grams", "counts"]


def _planes(values) -> bytes:
    """Small numbers byte by byte, first all lowest ones: most of the others are zeros, which compress."""
    return np.ascontiguousarray(np.asarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _pack(grp, kind, piece, docs=(), sets=(), sizes=(), values=(), counts=(), key=np.uint64):
    return (
        grp, kind, piece, np.asarray(docs, np.int64).tobytes(), np.asarray(sets, np.int64).tobytes(),
        _planes(sizes), np.asarray(values, key).tobytes(), _planes(counts),
    )


def _load(row, name: str, key=np.uint64) -> np.ndarray:
    kind = {"docs": np.int64, "sets": np.int64, "grams": key}.get(name)
    if kind is not None:
        return np.frombuffer(getattr(row, name), kind)
    planes = np.frombuffer(getattr(row, name), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def _usual(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _dealt(values: np.ndarray, owner: np.ndarray, slices: int):
    """(slice, values, owners) of every slice that has any."""
    where = (values % np.uint64(slices)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.searchsorted(where[order], np.arange(slices + 1))
    for f in np.flatnonzero(np.diff(cuts)):
        yield int(f), values[cuts[f] : cuts[f + 1]], owner[cuts[f] : cuts[f + 1]]


def _times(values: np.ndarray) -> np.ndarray:
    """How often each value stands there."""
    order = np.argsort(values, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], np.diff(values[order]) != 0)))
    times = np.diff(np.append(begins, len(values)))
    seen = np.empty(len(values), np.int64)
    seen[order] = np.repeat(times, times)
    return seen


def _need(n, percent: int):
    """The least overlap of a set of n with any that is similar enough."""
    return -(-percent * n // 100)


def _common(n):
    """Common n-grams that are looked for ahead, of sets of n at least."""
    return 1 + n // 8


def _ahead(size: int, percent: int, frequent, slices: int, buckets: int):
    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The keys of the first n-grams of each document by slices, and a row with what each needs of them."""
        known = frequent.value
        for batch in batches:
            for part in pieces(batch.text):
                sets = _sets(batch.text.iloc[part], size)
                docs = batch.doc_id.iloc[part].to_numpy()
                sizes = np.array([len(s) for s in sets], np.int64)
                need = _need(sizes, percent)
                firsts = [s[: n - m + _common(n)] for s, n, m in zip(sets, sizes, need)]
                every = np.concatenate(firsts)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in firsts])
                usual = _usual(every, known)
                # A partner has need n-grams at least, so that many common ones are among its first, too.
                wanted = np.maximum(_common(need) - np.bincount(owner[usual], minlength=len(sets)), 0)
                piece = _name(np.stack([docs, [_name(s) for s in sets]]).astype(np.int64).view(np.uint64).ravel())
                rows = [_pack(slices + piece % buckets, 1, piece, docs[sizes > 0], sizes=np.flatnonzero(sizes), counts=wanted)]
                for f, values, places in _dealt(every[~usual], owner[~usual], slices):
                    keys = (values >> np.uint64(20)).astype(np.uint32)
                    rows.append(_pack(f, 0, piece, sizes=places, values=keys, key=np.uint32))
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return ahead


def _again(slices: int, buckets: int):
    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Per piece the documents of the keys that occur again, one entry for each."""
        if key[0] >= slices:
            return rows.assign(grp=key[0] - slices)[_COLUMNS]
        parts = [_load(r, "grams", np.uint32) for r in rows.itertuples()]
        seen = np.split(_times(np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])
        out = [
            _pack(r.piece % buckets, 0, r.piece, sizes=_load(r, "sizes")[n > 1])
            for r, n in zip(rows.itertuples(), seen) if (n > 1).any()
        ]
        return pd.DataFrame(out, columns=_COLUMNS)

    return again


def _staying(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = [np.empty(0, np.int64)]
    for _, piece in rows.groupby("piece", sort=True):
        info = next(piece[piece.kind == 1].itertuples())
        wanted, places = _load(info, "counts"), _load(info, "sizes")
        found = [_load(r, "sizes") for r in piece[piece.kind == 0].itertuples()]
        times = np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=len(wanted))
        out.append(_load(info, "docs")[(times >= wanted)[places]])
    return pd.DataFrame({"doc_id": np.concatenate(out)})


def _bit(docs: np.ndarray, bits: int) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _in_map(docs: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = _bit(docs, 64 * len(words))
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _map_of_staying(rows: DataFrame, size: int, percent: int, frequent, total) -> np.ndarray:
    """A map of bits in which each document that may have a partner has its bit set.

    It is bounded: with more documents more of the others share a bit, and are counted as well.
    """
    slices = int((total[1] or 0) * (100 - percent + 13) / 600 // KEY_ROWS) + 4
    buckets = int((total[1] or 0) // BUCKET_BYTES) + 4
    each, least, most = MAP_BITS
    bits = 1 << int(min(max(each * total[0], least), most) - 1).bit_length()
    keys = rows.mapInPandas(_ahead(size, percent, frequent, slices, buckets), PACKED)
    again = keys.groupBy("grp").applyInPandas(_again(slices, buckets), PACKED)
    staying = again.groupBy("grp").applyInPandas(_staying, "doc_id bigint")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = _bit(batch.doc_id.to_numpy(), bits)
            yield pd.DataFrame({"word": at >> 6, "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    words = staying.mapInPandas(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def _read(size: int, frequent, staying, fragments: int, buckets: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each piece of a batch a row per fragment, and one that goes to its bucket."""
        known, stays = frequent.value, staying.value
        for batch in batches:
            for part in pieces(batch.text):
                sets = _sets(batch.text.iloc[part], size)
                docs = batch.doc_id.iloc[part].to_numpy()
                sizes = np.array([len(s) for s in sets], np.int64)
                names = np.array([_name(s) for s in sets], np.int64)
                sets = [s if stay else s[:0] for s, stay in zip(sets, _in_map(docs, stays))]
                every = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                usual = _usual(every, known)
                # The name of a piece follows from its rows: a task that runs again gives the same.
                piece = _name(np.stack([docs, names]).view(np.uint64).ravel())
                kept = np.bincount(owner[usual], minlength=len(sets))
                rows = [_pack(fragments + piece % buckets, 1, piece, docs, names, np.concatenate([sizes, kept]), every[usual])]
                for f, values, places in _dealt(every[~usual], owner[~usual], fragments):
                    rows.append(_pack(f, 0, piece, sizes=places, values=values))
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return read


def _count(fragments: int, buckets: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Per piece the n-grams of this fragment that occur again, with counts."""
        if key[0] >= fragments:  # what is known of the documents passes on to their bucket
            return rows.assign(grp=key[0] - fragments)[_COLUMNS]
        parts = [_load(r, "grams") for r in rows.itertuples()]
        seen = _times(np.concatenate(parts))
        out, at = [], 0
        for r, mine in zip(rows.itertuples(), parts):
            n = seen[at : at + len(mine)]
            at += len(mine)
            again = n > 1
            if again.any():
                place = _load(r, "sizes")[again]
                counts = np.minimum(n[again], np.iinfo(np.uint32).max - 1)
                out.append(_pack(r.piece % buckets, 0, r.piece, sizes=place, values=mine[again], counts=counts))
        return pd.DataFrame(out, columns=_COLUMNS)

    return count


def _gather(percent: int):
    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One row per document: its set and, if it may link at all, its repeating n-grams by fragment."""
        out = []
        for _, piece in rows.groupby("piece", sort=True):
            known = list(piece[piece.kind == 1].itertuples())
            found = list(piece[piece.kind == 0].itertuples())
            info = known[0]
            docs, names = _load(info, "docs"), _load(info, "sets")
            sizes, usual = np.split(_load(info, "sizes"), 2)
            owner = np.concatenate([np.repeat(np.arange(len(docs)), usual), *(_load(r, "sizes") for r in found)])
            values = np.concatenate([_load(info, "grams"), *(_load(r, "grams") for r in found)])
            top = np.full(int(usual.sum()), np.iinfo(np.uint32).max, np.int64)
            seen = np.concatenate([top, *(_load(r, "counts") for r in found)])
            order = np.lexsort((values, seen, owner))
            owner, values = owner[order], values[order]
            # The same piece twice (rows that repeat) brings each n-gram twice.
            once = np.ones(len(values), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
            owner, values, seen = owner[once], values[once].view(np.int64), seen[order][once]
            cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
            # Where the fragments of the order begin and end in each set.
            fragment = np.searchsorted(PIVOTS, seen, "left")
            width = len(PIVOTS) + 1
            ends = np.searchsorted(owner * width + fragment, np.arange(len(docs))[:, None] * width + np.arange(width + 1))
            ends = ends - cuts[:-1, None]
            need = _need(sizes, percent)
            for i in list(range(len(docs))) * len(known):
                mine = values[cuts[i] : cuts[i + 1]]
                may = sizes[i] > 0 and len(mine) >= need[i]
                segments = [mine[a:b] for a, b in zip(ends[i], ends[i][1:])] if may else None
                same = _name(mine.view(np.uint64)) if may else None
                out.append((docs[i], names[i], sizes[i], same, segments))
        return pd.DataFrame(out, columns=["doc_id", "name", "n", "same", "segments"])

    return gather


def _frequent(docs: DataFrame, size: int, rows: int) -> np.ndarray:
    """N-grams that two different texts of a bounded sample hold; only the order depends on it."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _sets(batch.text, size)
            name = np.repeat([_name(s) for s in sets], [len(s) for s in sets])
            gram = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pd.DataFrame({"gram": gram.view(np.int64), "name": np.asarray(name, np.int64)})

    held = docs.where(drawn).mapInPandas(sample, "gram bigint, name bigint")
    twice = held.groupBy("gram").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    return np.sort(twice.select("gram").toPandas().gram.to_numpy(np.int64).view(np.uint64))


def document_sets(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, name, n, same, segments): the set of each document, as far as links can need it.

    ``name`` stands for the whole set, ``same`` for its n-grams that repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    fragments = int((total[1] or 0) / 6 // SLICE_ROWS) + 4
    buckets = int((total[1] or 0) // BUCKET_BYTES) + 4
    frequent = spark.sparkContext.broadcast(_frequent(rows, size, total[0]))
    staying = spark.sparkContext.broadcast(_map_of_staying(rows, size, percent, frequent, total))
    packed = rows.mapInPandas(_read(size, frequent, staying, fragments, buckets), PACKED)
    answers = packed.groupBy("grp").applyInPandas(_count(fragments, buckets), PACKED)
    return landed(
        answers.groupBy("grp").applyInPandas(
            _gather(percent), "doc_id bigint, name bigint, n bigint, same bigint, segments array<array<bigint>>"
        ),
        "ngram-sets",
    )


def _overlaps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.intersect1d(x, y, assume_unique=True).size for x, y in zip(a, b)], dtype="int64")


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, other) that link: every fragment joins its segments and counts, the counts are summed per pair."""
    side = lambda s: segments.select(F.col("name").alias(s), "fragment", F.col("grams").alias(f"{s}_grams"))
    counted = (
        pairs.join(side("other"), "other").join(side("hub"), ["hub", "fragment"])
        .select("hub", "other", "sizes", F.pandas_udf(_overlaps, "bigint")("hub_grams", "other_grams").alias("overlap"))
        .groupBy("hub", "other", "sizes").agg(F.sum("overlap").alias("overlap"))
    )
    return counted.where(100 * F.col("overlap") >= percent * (F.col("sizes") - F.col("overlap"))).select("hub", "other")


def _flips(segments: pd.Series) -> pd.DataFrame:
    """FLIPS words of 64 bits, of which each n-gram flips one bit."""
    out = []
    for s in segments:
        at = (mix(np.concatenate(s).astype(np.int64).view(np.uint64)) % np.uint64(64 * FLIPS)).astype(np.int64)
        odd = (np.bincount(at, minlength=64 * FLIPS) & 1).astype(np.uint8)
        out.append(np.packbits(odd).view(np.int64))
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, FLIPS), columns=[f"w{i}" for i in range(FLIPS)])


def _within(classes: DataFrame, percent: int) -> DataFrame:
    """Links (hub, other) between classes of one R: from the smallest to all whose sizes allow it."""
    least = classes.groupBy("same").agg(F.min(F.struct(F.col("n").alias("hub_n"), F.col("name").alias("hub"))).alias("h"))
    fits = 100 * F.col("rep") >= percent * (F.col("n") + F.col("hub_n") - F.col("rep"))
    return (
        classes.join(least.select("same", "h.*"), "same")
        .where((F.col("name") != F.col("hub")) & fits).select("hub", F.col("name").alias("other"))
    )


def class_components(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that link; ``classes`` has one row (name, n, same, rep, segments) each."""
    segments = classes.select("name", F.posexplode("segments").alias("fragment", "grams")).where(F.size("grams") > 0)
    links = landed(_within(classes, percent), "ngram-links")
    tops = landed(components(links, "hub", "other"), "ngram-tops")
    # N-grams of one document come first in the order and use up the prefix.
    prefix = F.slice(F.flatten("segments"), F.lit(1), (F.col("rep") + 1 - F.ceil(percent * F.col("n") / 100)).cast("int"))
    rows = classes.select("name", "n", "same", "rep", F.explode(prefix).alias("gram"))
    # The largest set that an overlap of |R| can still link with a set of n.
    rows = rows.withColumn("cap", F.floor(F.col("rep") * (100 + percent) / percent) - F.col("n"))
    held = rows.groupBy("gram").agg(
        F.min("same").alias("a"), F.max("same").alias("b"), F.min("n").alias("least"), F.max("cap").alias("most")
    )
    able = rows.join(held.where("a <> b"), "gram").where("least <= cap AND most >= n").drop("a", "b", "least", "most", "cap")
    able = _once(able)
    active = _several(
        able.join(tops, F.col("name") == F.col("node"), "left")
        .select("gram", "name", "n", "same", "rep", F.coalesce("component", "name").alias("top"))
    )
    hubs_wanted = 1
    carried, flips = ["name", "n", "same", "rep", "top"], None
    while not active.isEmpty():
        # One hub for each salt of a gram: no window over a gram, only partial minima.
        salt = F.pmod(F.xxhash64("name", F.lit(hubs_wanted)), F.lit(hubs_wanted))
        if hubs_wanted > 1:
            salt = F.when(F.col("held") <= max(ALL_HUBS, hubs_wanted), F.xxhash64("name")).otherwise(salt)
            if flips is None:
                flips = landed(classes.select("name", F.pandas_udf(_flips, FLIPPED)("segments").alias("flips")), "ngram-flips")
                carried.append("flips")
            active = active.join(flips, "name")
        kept = F.struct(*[F.col(c).alias(f"hub_{c}" if c != "name" else "hub") for c in carried])
        hubs = active.groupBy("gram", salt.alias("salt")).agg(F.min(kept).alias("h")).select("gram", "h.*")
        sizes = F.col("n") + F.col("hub_n")
        alike = (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & (
            F.least("rep", "hub_rep") * (100 + percent) >= percent * sizes
        )
        if flips is not None:
            apart = sum((F.bit_count(F.col(f"flips.w{i}").bitwiseXOR(F.col(f"hub_flips.w{i}"))) for i in range(FLIPS)), F.lit(0))
            alike &= (F.col("rep") + F.col("hub_rep") - apart) * (100 + percent) >= 2 * percent * sizes
        pairs = (
            active.join(hubs, "gram")
            .where((F.col("top") != F.col("hub_top")) & (F.col("same") != F.col("hub_same")) & alike)
            .select(F.least("hub", "name").alias("hub"), F.greatest("hub", "name").alias("other"), sizes.alias("sizes"))
            .distinct()
        )
        found = landed(_verified(pairs, segments, percent), "ngram-links")
        if not found.isEmpty():
            links = links.union(found)
            tops = landed(components(links, "hub", "other"), "ngram-tops")
        # Hubs have met all others of their gram; what is left must still differ to be of interest.
        active = _several(
            active.join(hubs.select("gram", F.col("hub").alias("name")), ["gram", "name"], "left_anti")
            .drop("top", "held", "flips")
            .join(tops, F.col("name") == F.col("node"), "left")
            .select("gram", "name", "n", "same", "rep", F.coalesce("component", "name").alias("top"))
        )
        hubs_wanted *= HUB_GROWTH
    return tops


def _once(rows: DataFrame) -> DataFrame:
    """One n-gram of all that the same classes hold: the others would only bring the same pairs again.

    Classes are told by their number and 128 bits of their names.
    """
    names = [F.bit_xor(F.xxhash64("name", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    rows = landed(rows, "ngram-able")
    sets = rows.groupBy("gram").agg(F.count("*").alias("times"), *names)
    first = sets.groupBy("times", "s1", "s2").agg(F.min("gram").alias("gram")).select("gram")
    return rows.join(first, "gram", "left_semi")


def _several(rows: DataFrame) -> DataFrame:
    """The n-grams whose classes are in different components and of different R, with the number of their classes."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("top", "same") for f in (F.min, F.max)]
    several = rows.groupBy("gram").agg(*ends, F.count("*").alias("held")).where("top_min <> top_max AND same_min <> same_max")
    return landed(rows.join(several.select("gram", "held"), "gram"), "ngram-active")


def near_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: links of at least ``percent`` hundredths."""
    every = document_sets(docs, size, percent)
    every = every.withColumn("class", F.when(F.col("same").isNotNull(), F.xxhash64("same", "n")))
    may = every.where("same IS NOT NULL")
    rep = F.aggregate("segments", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x))
    classes = landed(
        may.dropDuplicates(["class"]).select(F.col("class").alias("name"), "n", "same", rep.alias("rep"), "segments"),
        "ngram-classes",
    )
    tops = class_components(classes, percent)
    # A class that links with another is one group, and so is one whose own members link: 2n is small enough.
    alone = 100 * F.col("rep") >= percent * (2 * F.col("n") - F.col("rep"))
    grouped = classes.select("name", alone.alias("alone")).join(tops, F.col("name") == F.col("node"), "left")
    grouped = grouped.select(
        F.col("name").alias("class"), F.when(F.col("component").isNotNull() | F.col("alone"), F.coalesce("component", "name")).alias("group")
    )
    # Otherwise only equal sets are linked. Groups and sets are told apart, as both are 64-bit names.
    placed = landed(
        every.select("doc_id", "n", "name", "class").join(grouped, "class", "left").select(
            "doc_id", "n", F.col("group").isNotNull().alias("linked"), F.when(F.col("n") > 0, F.coalesce("group", "name")).alias("top")
        ),
        "ngram-placed",
    )
    first = placed.where("top IS NOT NULL").groupBy("linked", "top").agg(F.min("doc_id").alias("first"))
    found = placed.join(first, ["linked", "top"], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("component_id"))
    if not placed.groupBy("doc_id").count().where("count > 1").isEmpty():
        # An id with several texts ties their groups together.
        tied = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        found = found.join(tied, F.col("doc_id") == F.col("node"), "left").select(
            "doc_id", "n", F.coalesce("component", "component_id").alias("component_id")
        )
    lost = docs.where("doc_id IS NULL")
    return found.withColumnRenamed("n", "n_shingles").union(
        lost.mapInPandas(_sizes(size), "doc_id bigint, n_shingles bigint, component_id bigint")
    )


def _sizes(size: int):
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(s) for s in _sets(batch.text, size)]
            none = pd.array([None] * len(n), "Int64")
            yield pd.DataFrame({"doc_id": none, "n_shingles": n, "component_id": none})

    return sizes


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 5-word shingles, similarity 0.75."""
    return near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS pos FROM tokens WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * overlap >= 75 * (x.n + y.n - overlap)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, s.n
"""
QUERIES = {"op8_ngram_join": op8_ngram_join}
ORACLE = {"op8_ngram_join": SQL}
