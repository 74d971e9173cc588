"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` long, trained on the whole
training part of the corpus: for each context it holds how often each byte followed.
A byte is predicted from the longest context that was seen; a byte that never
followed there escapes to the next shorter one (method C: as many escape counts as
distinct bytes), where the bytes of the longer context are excluded, down to all
bytes alike. 0xFF, which no text holds, stands before each text and ends it, so the
score of a text is the log10 probability of its bytes and its end: the code length.

Nothing of the size of the corpus is broadcast. Each task reads texts in blocks of
about ``BLOCK`` bytes; a block gives its distinct words and its distinct strings of
``ORDER`` + 1 bytes with their training counts, packed by hashes of the words and the
strings. Packs meet by hash and counts are summed; the distinct strings of contexts that
agree in their last two bytes are then worked out together (orders 0 and 1, at most
65,792 counts, go to every task). Counts and log probabilities return to the blocks,
where the texts are scored whole.

Blocks are made twice from the same partitions, so ``docs`` must give the same rows
when it is read again, as a table does; a difference is noticed and raises an error.

Edge cases: null text is empty, one end token and one end byte; without training rows
every byte has 1/256 and every count is 0; repeated rows are scored, and learned, as
often as they come; null ids are not held out; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logmill.llm.common import lower_ascii
from logmill.llm.packs import (
    by_bucket, pack, pack_floats, pack_sorted, pack_words, tidy, unpack, unpack_floats, unpack_sorted, unpack_words,
)
from logmill.session import materialize

ORDER = 5
END = 0xFF
BLOCK = 10 << 20
PART = 1 << 19
BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


# --- strings and words of a part -----------------------------------------------


def byte_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and each text's end, the number made of it and the
    ``ORDER`` bytes before it; and where each text begins among these."""
    gap = bytes([END]) * (ORDER + 1)
    data = np.frombuffer(gap[:ORDER] + gap.join(texts) + gap[:1], np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    if not texts:
        return np.zeros(0, np.int64), begins
    codes = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        codes <<= 8
        codes |= data[k : k + len(codes)]
    keep = np.ones(len(codes), bool)
    for k in range(ORDER):  # the marks between texts
        keep[(begins + sizes + np.arange(len(texts)) * ORDER + k)[:-1]] = False
    return codes[keep], begins


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words, each with a blank behind it, and how many each text has."""
    plain, counts = [], []
    for text in texts:
        row = text.translate(BLANKS).strip(b" ")
        if b"  " in row:
            row = b" ".join(row.split())
        if row:
            plain.append(row)
        counts.append(row.count(b" ") + 1 if row else 0)
    data = b" ".join(plain) + b" " if plain else b""
    ends = np.nonzero(np.frombuffer(data, np.uint8) == 0x20)[0] + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
    return words, np.array(counts, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Block, part and rows of at most about ``PART`` bytes."""
    block, part, size, partition = 0, 0, 0, 0
    for batch in batches:
        texts = batch.column("text")
        if not len(texts):
            continue
        partition = batch.column("partition")[0].as_py()
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PART, side="right")) - 1)
            yield (partition << 24) + block, part, batch.slice(start, stop - start)
            part += 1
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= BLOCK:
                block, part, size = block + 1, 0, 0


def _texts(rows: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in rows.column("text").to_pylist()]


def _whole_blocks(batches: Iterator[pa.RecordBatch]):
    """Per block, its parts' words, word counts, training marks and byte strings."""
    held, now = [], None
    for block, _, rows in _blocks(batches):
        if held and block != now:
            yield now, held
            held = []
        now = block
        texts = _texts(rows)
        train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
        words, counts = words_of(texts)
        codes, begins = byte_strings(texts)
        learn = np.repeat(train, np.diff(np.append(begins, len(codes))))
        held.append((words, np.repeat(train, counts), np.unique(codes[learn], return_counts=True), np.unique(codes[~learn])))
    if held:
        yield now, held


GATHERED = (
    "kind string, bucket int, block long, keys binary, sizes binary, counts binary, pairs array<int>, times array<long>"
)
SPREAD = 1000003


def _gather(schema: pa.Schema, buckets: int):
    """Each block's distinct words and byte strings with their training counts, packed
    by a hash, and the training counts of pairs of bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _whole_blocks(batches):
            encoded = pa.chunked_array([p[0] for p in parts]).dictionary_encode()
            words = [w.encode() for w in encoded.chunk(0).dictionary.to_pylist()]
            counts = np.zeros(len(words), np.int64)
            for chunk, part in zip(encoded.chunks, parts, strict=True):
                counts += np.bincount(chunk.indices.to_numpy()[part[1]], minlength=len(words))
            for bucket, own in by_bucket(np.array([zlib.crc32(w) for w in words], np.int64) % buckets, buckets):
                names = sorted(own.tolist(), key=words.__getitem__)
                sizes, data = pack_words([words[i] for i in names])
                row = {"kind": "word", "bucket": bucket, "block": block, "keys": data, "sizes": sizes}
                yield pa.RecordBatch.from_pylist([row | {"counts": pack(np.array([names, counts[names]]).ravel())}], schema)
            every = np.concatenate([x for p in parts for x in (p[2][0], p[3])])
            times = np.concatenate([x for p in parts for x in (p[2][1], np.zeros(len(p[3]), np.int64))])
            codes, sums = _sums(every, times)
            for bucket, own in by_bucket(codes % SPREAD % buckets, buckets):
                row = {"kind": "string", "bucket": bucket, "block": block, "keys": pack_sorted(codes[own])}
                yield pa.RecordBatch.from_pylist([row | {"counts": pack(sums[own])}], schema)
            pairs = np.bincount(codes & 0xFFFF, sums, 1 << 16)
            seen = np.flatnonzero(pairs)
            row = {"kind": "pair", "bucket": 0, "block": block, "pairs": seen.tolist(), "times": pairs[seen].astype(int).tolist()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return make


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus counts of the words of each pack, once all packs of a partition were
    seen, and how many words and tokens of training texts the partition has."""
    packs, totals = [], {}
    for batch in batches:
        for row in batch.to_pylist():
            packs.append(row)
            names, counts = unpack_words(row["sizes"], row["keys"]), unpack(row["counts"]).reshape(2, -1)[1].tolist()
            for name, count in zip(names, counts, strict=True):
                totals[name] = totals.get(name, 0) + count
    for row in packs:
        sums = np.array([totals[w] for w in unpack_words(row["sizes"], row["keys"])], np.int64)
        numbers = unpack(row["counts"]).reshape(2, -1)[0]
        yield _numbers_row(row["block"], pack(numbers), zlib.compress(sums.astype("<i8").tobytes(), 1), None, None)
    if totals:
        yield _numbers_row(None, None, None, sum(totals.values()), sum(1 for n in totals.values() if n))


COUNTED = "block long, numbers binary, counts binary, tokens long, words long"


def _numbers_row(block, numbers, counts, tokens, words) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    values = (block, numbers, counts, tokens, words)
    names = [c.split()[0] for c in COUNTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def _sum_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct byte strings of a partition's packs and their training counts."""
    codes, sums, held, size = np.zeros(0, np.int64), np.zeros(0), [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append((unpack_sorted(row["keys"]), unpack(row["counts"]).astype(float)))
            size += len(held[-1][0])
            if size > 1_000_000 + len(codes):
                codes, sums = _sums(np.concatenate([codes, *(c for c, _ in held)]), np.concatenate([sums, *(n for _, n in held)]))
                held, size = [], 0
    if held:
        codes, sums = _sums(np.concatenate([codes, *(c for c, _ in held)]), np.concatenate([sums, *(n for _, n in held)]))
    for start in range(0, len(codes), 50_000):
        part = slice(start, start + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(sums[part].astype(np.int64))], ["code", "n"])


def _value_packs(packs: pa.Table, values: pa.Table) -> pa.Table:
    """The values of the strings of each pack of a bucket."""
    code, value = values.column("code").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(code)
    code, value = code[order], value[order]
    out = [pack_floats(value[np.searchsorted(code, unpack_sorted(k))]) for k in packs.column("keys").to_pylist()]
    return pa.table({"block": packs.column("block"), "keys": packs.column("keys"), "values": pa.array(out, pa.binary())})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts, part by part, with their block."""
    for block, part, rows in _blocks(batches):
        ids = rows.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block]),
                pa.array([part], pa.int32()),
                pa.array([ids.to_pylist()], pa.list_(ids.type)),
                pa.array([rows.column("text").to_pylist()], pa.list_(pa.string())),
            ],
            ["block", "part", "doc_ids", "texts"],
        )


# --- the model -----------------------------------------------------------------


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[place] == keys, place, -1)


class Level:
    """Contexts of one order: their bytes and counts, totals and distinct bytes, and
    what is left of the next shorter context once these bytes are excluded."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.order, self.keys, self.counts = order, keys, counts
        self.contexts, place = np.unique(keys >> 8, return_inverse=True)
        self.total = np.bincount(place, counts, len(self.contexts))
        self.distinct = np.bincount(place, minlength=len(self.contexts)).astype(float)
        if shorter is not None and len(keys):
            below = shorter.counts[_find(shorter.keys, keys & ((1 << (8 * order)) - 1))]
            context = _find(shorter.contexts, self.contexts & ((1 << (8 * (order - 1))) - 1))
            self.left_total = shorter.total[context] - np.bincount(place, below, len(self.contexts))
            self.left_distinct = shorter.distinct[context] - self.distinct


def levels(codes: np.ndarray, counts: np.ndarray, low: list[Level], orders) -> list[Level]:
    """Levels of the given orders, ascending, on top of the levels ``low``."""
    found = list(low)
    for order in orders:
        keys, sums = _sums(codes & ((1 << (8 * (order + 1))) - 1), counts)
        found.append(Level(order, keys, sums, found[-1] if found else None))
    return found


def log_probabilities(codes: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each string, given those before it."""
    result, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
    longer = np.full(len(codes), -1)
    above = None
    for level in reversed(trie):
        keys = codes & ((1 << (8 * (level.order + 1))) - 1)
        context, place = _find(level.contexts, keys >> 8), _find(level.keys, keys)
        seen = context >= 0
        total = np.where(seen, level.total[context], 0.0) if len(level.contexts) else np.zeros(len(codes))
        distinct = np.where(seen, level.distinct[context], 0.0) if len(level.contexts) else np.zeros(len(codes))
        if above is not None and len(above.contexts):
            total = np.where(longer >= 0, above.left_total[longer], total)
            distinct = np.where(longer >= 0, above.left_distinct[longer], distinct)
        here = open_ & (place >= 0)
        result[here] += np.log10(level.counts[place[here]] / (total[here] + distinct[here]))
        open_ &= ~here
        escape = open_ & (distinct > 0)
        result[escape] += np.log10(distinct[escape] / (total[escape] + distinct[escape]))
        longer, above = context, level
    lowest = trie[0].distinct[0] if trie and len(trie[0].distinct) else 0.0
    result[open_] -= np.log10(256 - lowest)
    return result


# --- scoring -------------------------------------------------------------------


class _Table:
    """Values of known codes: a slot by hash, and a search for those that share one."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        bits = max(16, (4 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[self._slot(self.codes)] = np.arange(len(self.codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            raise ValueError(CHANGED)
        place = self.slots[self._slot(codes)]
        missed = np.nonzero(self.codes[place] != codes)[0]
        place[missed] = _find(self.codes, codes[missed])
        if (place < 0).any():
            raise ValueError(CHANGED)
        return self.values[place]


CHANGED = "the input gave other rows when it was read again; write it as a table first"


def ppm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row, learned from the rows where ``held_out`` is false.

    ``base_score`` is that of a word model with one added to each count."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", lower_ascii(F.col("text")).alias("text"), (~held_out).alias("train"),
        F.spark_partition_id().alias("partition"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(StructType.fromDDL(GATHERED))
    gathered = materialize(rows.mapInArrow(tidy(_gather(schema, 4 * tasks)), GATHERED), "ppm-packs")

    words, strings = gathered.where("kind = 'word'"), gathered.where("kind = 'string'")
    texts = rows.agg(F.count_if("train").alias("n")).first()["n"]
    counted = materialize(words.repartition(tasks, "bucket").mapInArrow(tidy(_sum_words), COUNTED), "ppm-words")
    sizes = counted.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    n_all, v_all = int(sizes["n"] or 0) + texts, int(sizes["v"] or 0) + (texts > 0)

    pairs = gathered.where("kind = 'pair'").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    pairs = pairs.groupBy("p.pairs").agg(F.sum("p.times").alias("n")).toPandas()
    low = spark.sparkContext.broadcast(
        levels(pairs["pairs"].to_numpy(np.int64), pairs["n"].to_numpy(np.float64), [], range(2))
    )
    trie = strings.repartition(tasks, "bucket").mapInArrow(tidy(_sum_strings), "code long, n long")

    def predict(group: pa.Table) -> pa.Table:
        codes, counts = group.column("code").to_numpy(), group.column("n").to_numpy().astype(np.float64)
        seen = counts > 0
        found = levels(codes[seen], counts[seen], low.value, range(2, ORDER + 1))
        return pa.table({"code": codes, "value": log_probabilities(codes, found)})

    family = F.expr("shiftright(code, 8) & 65535")
    predicted = (
        trie.withColumn("family", F.pmod(F.xxhash64(family), F.lit(4 * tasks)))
        .groupBy("family")
        .applyInArrow(predict, "code long, value double")
    )
    values = predicted.withColumn("bucket", (F.col("code") % SPREAD % (4 * tasks)).cast("int"))
    valued = strings.select("bucket", "block", "keys").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(
        _value_packs, "block long, keys binary, `values` binary"
    )
    known = (
        counted.where("block IS NOT NULL")
        .select("block", "numbers", "counts")
        .unionByName(valued, allowMissingColumns=True)
    )
    parts = rows.select("doc_id", "text", "partition").mapInArrow(
        _parts, f"block long, part int, doc_ids array<{kind}>, texts array<string>"
    )
    result = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    schema = to_arrow_schema(StructType.fromDDL(result))
    below = np.log10(n_all + v_all + 1.0)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        numbered, coded = right.filter(right.column("numbers").is_valid()), right.filter(right.column("keys").is_valid())
        numbers = np.concatenate([np.zeros(0, np.int64), *map(unpack, numbered.column("numbers").to_pylist())]).astype(np.int64)
        sums = [np.frombuffer(zlib.decompress(c), "<i8") for c in numbered.column("counts").to_pylist()]
        counts = np.zeros(len(numbers), np.int64)
        if len(numbers) and int(numbers.max()) + 1 != len(numbers):
            raise ValueError(CHANGED)
        counts[numbers] = np.concatenate([np.zeros(0, np.int64), *sums])
        table = _Table(
            np.concatenate([np.zeros(0, np.int64), *map(unpack_sorted, coded.column("keys").to_pylist())]),
            np.concatenate([np.zeros(0), *map(unpack_floats, coded.column("values").to_pylist())]),
        )
        left = left.sort_by("part")
        parts_ = [[t.encode() for t in row] for row in left.column("texts").to_pylist()]
        split = [words_of(p) for p in parts_]
        encoded = pa.chunked_array([w for w, _ in split], pa.string()).dictionary_encode()
        if encoded.num_chunks and len(encoded.chunk(0).dictionary) != len(counts):
            raise ValueError(CHANGED)
        logs = np.log10(counts + 1.0) - below
        end = np.log10(texts + 1.0) - below
        out = []
        for part, (_, sizes_), chunk, ids in zip(parts_, split, encoded.chunks, left.column("doc_ids").to_pylist(), strict=True):
            index = chunk.indices.to_numpy()
            cuts = np.concatenate([[0], np.cumsum(sizes_)])
            base = np.concatenate([[0.0], np.cumsum(logs[index])])
            told = np.concatenate([[0], np.cumsum(counts[index] > 0)])
            codes, begins = byte_strings(part)
            out.append(
                pa.table(
                    [
                        pa.array(ids, schema.field("doc_id").type),
                        pa.array(sizes_ + 1),
                        pa.array(np.diff(told[cuts]) + (1 if texts else 0)),
                        pa.array(np.diff(base[cuts]) + end),
                        pa.array(np.add.reduceat(table.get(codes), begins)),
                    ],
                    schema,
                )
            )
        return pa.concat_tables(out) if out else schema.empty_table()

    scored = parts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(finish, result)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
