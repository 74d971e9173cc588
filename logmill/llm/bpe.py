"""Byte-level BPE encoding and decoding.

Words are what the public splitting pattern matches. Each task reads its texts in
blocks of about ``BLOCK`` bytes; a block gives its distinct words, numbered and packed
by their hash, and its texts as word numbers. The packs of all blocks meet by hash, and
Spark higher-order functions fold the ranked merges over the bytes of each distinct
word once (``fold_merges``, with the ranks from a subquery); the ids go back to the blocks. A task then puts a
block's numbers and ids together and decodes by concatenating the binary pieces of
the ids. So merges are worked out once for each distinct word of the corpus, texts
move only as compressed word numbers, and a task holds one block, or the distinct words
of its hashes (four to each of spark.sql.shuffle.partitions).

Blocks are made twice from the same partitions, so ``docs`` must give the same rows
when it is read again, as a table does; a difference is noticed and raises an error.

Edge cases: null and empty texts have no ids and decode to nothing; repeated rows are
encoded as often as they come; a null id is returned as it is; an empty table gives an
empty table; extra columns are ignored. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logmill.llm.packs import by_bucket, pack, pack_words, tidy, unpack, unpack_words

BUCKETS = 1 << 15
FIRST_SIGN = 0x10000
NO_MERGE = chr(0x10FFFF)
BYTES = "".join(map(chr, range(256)))
BLOCK = 12 << 20
PART = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _sign(number: int) -> str:
    """An id as one character; characters compare as the ids do."""
    return chr(FIRST_SIGN + number)


def rank_maps(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """Which id, as a sign, two adjacent ids merge into: an array of small maps, the place
    of a pair given by its hash, so that a look-up compares one or two keys.

    It is a subquery on a table of one row. A literal would be written out, with all its
    pairs, in every description of every plan that the driver keeps or sends to listeners."""
    maps: list[list[tuple[str, str]]] = [[] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pair = _sign(left) + _sign(right)
                maps[xxhash.xxh64_intdigest(pair.encode(), 42) % BUCKETS].append((pair, _sign(rank)))
    column = pa.array([maps], pa.list_(pa.map_(pa.string(), pa.string())))
    return spark.createDataFrame(pa.table({"maps": column})).scalar()


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fold_merges(word: Column, ranks: dict[bytes, int], maps: Column) -> Column:
    """The ids of a word: its bytes, with the adjacent pair of least rank merged (the
    leftmost of equals) until no pair has a rank.

    The fold's state is the ids as signs and, as signs too, what each adjacent pair
    merges into; a merge changes one id and the two pairs beside it. Where a word with
    a rank of its own would not be merged into that id, it takes it all the same."""
    empty = F.lit("")

    def merged(maps: Column, pair: Column) -> Column:
        place = F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).cast("int")
        return F.coalesce(F.get(maps, place)[pair], F.lit(NO_MERGE))

    def state(ids: Column, pairs: Column) -> Column:
        return F.struct(ids.alias("ids"), pairs.alias("pairs"))

    def fold(maps: Column) -> Column:
        def start(ids: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(1), F.length(ids) - 1), lambda i: merged(maps, F.substring(ids, i, F.lit(2)))
            )
            return state(ids, F.when(F.length(ids) < 2, empty).otherwise(F.array_join(pairs, "")))

        def step(now: Column, _: Column) -> Column:
            ids, pairs = now["ids"], now["pairs"]

            def merge(least: Column) -> Column:
                def at(k: Column) -> Column:  # 1 for the first pair
                    left = F.when(k > 1, merged(maps, F.concat(F.substring(ids, k - 1, F.lit(1)), least)))
                    right = F.when(k < F.length(pairs), merged(maps, F.concat(least, F.substring(ids, k + 2, F.lit(1)))))
                    before = F.when(k > 2, F.substring(pairs, F.lit(1), k - 2)).otherwise(empty)
                    return state(
                        F.concat(F.substring(ids, F.lit(1), k - 1), least, F.substring(ids, k + 2, F.length(ids))),
                        F.concat(
                            before, F.coalesce(left, empty), F.coalesce(right, empty),
                            F.substring(pairs, k + 2, F.length(pairs)),
                        ),
                    )

                place = F.call_function("instr", pairs, least)
                return F.when(least == NO_MERGE, state(ids, empty)).otherwise(_let(place, at))

            return F.when(F.length(pairs) == 0, now).otherwise(_let(F.array_min(F.split(pairs, "")), merge))

        return F.aggregate(F.sequence(F.lit(1), F.length(name)), _let(F.translate(name, BYTES, signs), start), step)["ids"]

    name = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    signs = "".join(_sign(ranks[bytes([b])]) for b in range(256))
    folded = F.transform(F.split(_let(maps, fold), ""), lambda sign: F.ascii(sign) - FIRST_SIGN)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(folded)


def own_ids(ranks: dict[bytes, int]) -> dict[str, int]:
    """Words with a rank whose merges end elsewhere. Few, as a rule none."""
    found = {}
    for piece, rank in ranks.items():
        parts = [ranks[bytes([b])] for b in piece]
        names = [bytes([b]) for b in piece]
        while len(parts) > 1:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(names, names[1:], strict=False)) if a + b in ranks]
            if not options:
                break
            best, i = min(options)
            parts[i : i + 2], names[i : i + 2] = [best], [names[i] + names[i + 1]]
        if parts != [rank]:
            try:
                found[piece.decode()] = rank
            except UnicodeDecodeError:  # not a word of any text
                continue
    return found


# --- words ---------------------------------------------------------------------

#: White space of the splitting pattern. Fixed values.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = range(4)
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """The kind of each code point."""
    if not _kinds:
        first = {"L": LETTER, "N": NUMBER}
        kinds = np.array([first.get(category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        kinds[SPACES] = SPACE
        _kinds.append(kinds)
    return _kinds[0]


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks where the words of the pattern start in code points of texts that begin
    at ``begins``. Words are runs of one kind; a run takes a single blank before it
    along; of other white space before a word the last character stands alone; a
    contraction is a word where an apostrophe starts one."""
    n = len(points)
    starts, first = np.zeros(n, bool), np.zeros(n + 1, bool)
    if n == 0:
        return starts
    first[begins] = True
    first[n] = True
    kinds = _kind_table()[points]
    space = kinds == SPACE
    change = np.ones(n, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change |= first[:n]
    follows = ~first[:n]  # has a character of the same text before it
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= follows
    starts[:] = change & (space | ~after_blank)
    last = np.zeros(n, bool)  # white space right before a word
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts |= last
    quotes = np.nonzero((points == 0x27) & starts & change)[0]
    if len(quotes):
        padded = np.append(points, [0, 0, 0])
        bounded = np.append(first, [True, True])
        one, two = padded[quotes + 1], padded[quotes + 2]
        near = ~bounded[quotes + 1]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= near & ~bounded[quotes + 2]
        for chosen, size in ((quotes[short], 2), (quotes[pair], 3)):
            starts[chosen + 1] = False
            rest = chosen + size
            rest = rest[(rest < n)]
            rest = rest[(kinds[rest] == LETTER) & ~first[rest]]
            starts[rest] = True
    return starts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts (none of them null), in order, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(ends[0]), int(ends[-1])
    data = texts.buffers()[2].slice(low, high - low) if high > low else pa.py_buffer(b"")
    points = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), np.uint32)
    width = np.ones(len(points), np.int8)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += points > limit
    place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    begins = np.searchsorted(place, ends - low)
    at = np.nonzero(word_starts(points, begins[:-1][begins[:-1] < len(points)]))[0]
    offsets = np.append(place[at], high - low).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), data)
    return words, np.diff(np.searchsorted(at, begins))


# --- blocks --------------------------------------------------------------------


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array], pa.ChunkedArray, list[np.ndarray]]]:
    """The rows of a partition in blocks of about ``BLOCK`` bytes: the block's number,
    doc ids by part, words by part in one dictionary, and word counts by part."""
    number, size, ids, words, counts = 0, 0, [], [], []
    partition = 0
    for batch in batches:
        texts = batch.column("text")
        if len(texts):
            partition = batch.column("partition")[0].as_py()
        for start, stop in _parts(texts, PART):
            found, per_text = split_words(texts.slice(start, stop - start))
            ids.append(batch.column("doc_id").slice(start, stop - start))
            words.append(found)
            counts.append(per_text)
            size += found.buffers()[2].size if len(found) else 0
            if size >= BLOCK:
                yield (partition << 24) + number, ids, pa.chunked_array(words).dictionary_encode(), counts
                number, size, ids, words, counts = number + 1, 0, [], [], []
    if ids:
        yield (partition << 24) + number, ids, pa.chunked_array(words).dictionary_encode(), counts


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _word_packs(schema: pa.Schema, buckets: int):
    """Each block's distinct words, numbered as they first come and packed by a hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, words, _ in _blocks(batches):
            dictionary = words.chunk(0).dictionary if words.num_chunks else pa.array([], pa.string())
            names = [w.encode() for w in dictionary.to_pylist()]
            bucket = np.array([zlib.crc32(w) for w in names], np.int64) % buckets
            for number, places in by_bucket(bucket, buckets):
                own = sorted(places.tolist(), key=names.__getitem__)
                sizes, data = pack_words([names[i] for i in own])
                row = {"bucket": number, "block": block, "numbers": pack(np.array(own)), "sizes": sizes, "words": data}
                yield _batch(schema, [row])

    return make


def _text_packs(schema: pa.Schema):
    """Each block's texts, part by part, as the numbers of their words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, words, counts in _blocks(batches):
            for doc_ids, chunk, per_text in zip(ids, words.chunks, counts, strict=True):
                row = {"block": block, "doc_ids": doc_ids.to_pylist(), "counts": per_text.tolist()}
                yield _batch(schema, [row | {"numbers": pack(chunk.indices.to_numpy())}])

    return make


def _distinct_words(schema: pa.Schema):
    """The distinct words of a partition's packs as rows; after the words of a pack, a
    row that says which of all words so far the pack holds."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                before, words = len(known), unpack_words(row["sizes"], row["words"])
                picks = np.array([known.setdefault(w, len(known)) for w in words])
                fresh = [{"word": w} for w, i in zip(words, picks, strict=True) if i >= before]
                yield _batch(schema, [*fresh, {"block": row["block"], "numbers": row["numbers"], "picks": pack(picks)}])

    return make


def _id_packs(schema: pa.Schema, special: dict[str, int]):
    """For each pack of words, in the order of its numbers, the ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            is_word = batch.column("block").is_null()
            lists = batch.column("ids").filter(is_word)
            if special:
                words = batch.column("word").filter(is_word).to_pylist()
                found = [[special[w]] if w in special else i for w, i in zip(words, lists.to_pylist(), strict=True)]
                lists = pa.array(found, pa.list_(pa.int32()))
            if len(lists):
                sizes = np.concatenate([sizes, lists.value_lengths().to_numpy()])
                ids = np.concatenate([ids, lists.flatten().to_numpy()])
                starts = _starts(sizes)
            for row in batch.filter(batch.column("block").is_valid()).drop_columns(["word", "ids"]).to_pylist():
                chosen = unpack(row.pop("picks"))
                row |= {"sizes": pack(sizes[chosen]), "ids": pack(_gather(ids, starts, sizes, chosen)[0])}
                yield _batch(schema, [row])

    return make


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen pieces of ``flat`` one after the other, and where each one ends."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[chosen] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _bounds(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where texts of so many pieces begin and end, given the ends of the pieces."""
    return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]


#: What ``encode_texts`` can give for each row.
COLUMNS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string",
}


def _lists(kind: pa.DataType, parts: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    """Lists or binary values of the given sizes from values one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    if pa.types.is_binary(kind):
        flat = np.concatenate([np.zeros(0, np.uint8), *parts])
        return pa.BinaryArray.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    flat = np.concatenate([np.zeros(0, np.int32), *(p.view(np.int32) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=kind)


def encode_texts(docs: DataFrame, rank_path: str, columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id and the asked ``COLUMNS`` of each row's whole text: its ids, the bytes
    decoded from them, their number and digests (ids as little-endian 32-bit numbers)."""
    ranks = read_ranks(rank_path)
    spark = docs.sparkSession
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    pieces = spark.sparkContext.broadcast((np.array([r for _, r in by_rank]), [p for p, _ in by_rank]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("partition"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    # words meet by hash; the folded ids of a distinct word serve all packs of a task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def step(frame: DataFrame, make, columns: str, *more) -> DataFrame:
        return frame.mapInArrow(tidy(make(to_arrow_schema(StructType.fromDDL(columns)), *more)), columns)

    texts = step(rows, _text_packs, f"block long, doc_ids array<{kind}>, counts array<int>, numbers binary")
    packs = step(rows, _word_packs, "bucket int, block long, numbers binary, sizes binary, words binary", 4 * tasks)
    distinct = step(
        packs.repartition(tasks, "bucket"), _distinct_words, "word string, block long, numbers binary, picks binary"
    )
    ids = F.when(F.col("word").isNotNull(), fold_merges(F.col("word"), ranks, F.col("maps")))
    # used once, so the optimizer puts the subquery in its place and no row carries the maps
    folded = distinct.withColumn("maps", rank_maps(spark, ranks)).select(*distinct.columns, ids.alias("ids"))
    words = step(folded, _id_packs, "block long, numbers binary, sizes binary, ids binary", own_ids(ranks))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [[unpack(x) for x in right.column(c).to_pylist()] for c in ("numbers", "sizes", "ids")]
        numbers, lengths, flat = (np.concatenate([np.zeros(0, "<u4"), *x]) for x in held)
        order = np.argsort(numbers)
        if not np.array_equal(numbers[order], np.arange(len(numbers))):
            raise ValueError("the input gave other rows when it was read again; write it as a table first")
        lengths = lengths.astype(np.int64)
        starts, lengths = _starts(lengths)[order], lengths[order]
        known, names = pieces.value
        piece_sizes, piece_flat = np.zeros(int(known.max()) + 1, np.int64), np.frombuffer(b"".join(names), np.uint8)
        piece_sizes[known] = [len(p) for p in names]
        piece_starts = _starts(piece_sizes)
        out = {name: [] for name in schema.names}
        sizes = {"ids": [np.zeros(0, np.int64)], "decoded": [np.zeros(0, np.int64)]}
        for doc_ids, counts, packed in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "counts", "numbers")), strict=True):
            ids, ends = _gather(flat, starts, lengths, unpack(packed))
            cuts = _bounds(ends, np.array(counts, np.int64))
            text, piece_ends = _gather(piece_flat, piece_starts, piece_sizes, ids)
            byte_cuts = _bounds(piece_ends, np.diff(cuts))
            out["doc_id"] += doc_ids
            for name, values, places in (("ids", ids, cuts), ("decoded", text, byte_cuts)):
                sizes[name].append(np.diff(places))
                if name in out:
                    out[name].append(values)
                if f"{name}_sha256" in out:
                    out[f"{name}_sha256"] += [
                        hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(places, places[1:], strict=False)
                    ]
            if "n_tokens" in out:
                out["n_tokens"] += np.diff(cuts).tolist()
        arrays = [
            _lists(field.type, out[field.name], np.concatenate(sizes[field.name]))
            if field.name in sizes
            else pa.array(out[field.name], field.type)
            for field in schema
        ]
        return pa.Table.from_arrays(arrays, schema=schema)

    result = ", ".join([f"doc_id {kind}", *(f"{c} {COLUMNS[c]}" for c in columns)])
    schema = to_arrow_schema(StructType.fromDDL(result))
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(finish, result)
