"""Phrases of two and three words that stand together more often than chance.

The corpus is kept as vertical positional inverted lists: a block of documents holds, for
each word of a language, the sorted positions of its occurrences (positions leave a gap
where a piece of text ends, so neighbours are words of one piece).  A phrase's list is
extended by a merge join of its positions, moved by its length, with the postings of all
words; what matches is the longer phrase's list, and the lengths of its lists in all
blocks add up to its exact frequency.  Only phrases whose parts are frequent are extended.

Blocks and counts meet in slices: a block sends the lengths of its lists, dealt by a hash of
the phrase, in one row a slice; a slice adds them up and tells each block which of its
phrases are frequent.  Positions themselves stay in their block.  A phrase is one entry a
block in a slice, however often it occurs, so none is hot; slices grow in number with the
corpus and hold about as much each.

Defined results: null and empty texts hold nothing; a null language is ``und``; repeated
rows count each; ids don't matter; an empty table gives no rows; ties of scores go to
the more frequent phrase, then by bytes; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mix

#: Least frequency of a phrase, phrases reported for each language, and the share of a
#: phrase's occurrences inside a longer one, in percent, from which the longer stands for it.
LEAST, TOP, INSIDE = 10, 2000, 50
UNKNOWN = "und"
#: Bytes of text in a block, and for each slice; slices at least.
BLOCK_BYTES, SLICE_BYTES, SLICES = 8 << 20, 8 << 20, 64

#: Lower case of A-Z; marks that end a piece as line feeds, tabs as spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_SPACE, _END = 32, 10


def _lists(texts: list[bytes], langs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Vertical lists of some texts: language and word of each list, its length, and
    all positions, list after list."""
    joined = b"\n".join(texts).translate(_TABLE)
    buf = np.frombuffer(joined, np.uint8)
    apart = (buf == _SPACE) | (buf == _END)
    edge = np.diff(np.concatenate(([True], apart, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece = np.cumsum(buf == _END, dtype=np.int32)[start]
    at = np.arange(len(start)) + np.concatenate(([0], np.cumsum(np.diff(piece) > 0)))
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[~apart].tobytes())]).dictionary_encode()
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    lang = langs[np.searchsorted(np.cumsum(sizes), start, side="right")]
    width = len(words.dictionary)
    key = lang * width + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    kind, word = np.divmod(key[order][first], width)
    return kind, words.dictionary.take(pa.array(word)).cast(pa.binary()).cast(pa.string()), np.diff(np.append(first, len(order))), at[order]


def _gaps(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first position of each list and the steps to the next ones."""
    out = np.diff(at, prepend=0)
    first = np.cumsum(sizes) - sizes
    out[first] = at[first]
    return out


def _positions(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - gaps[first], sizes)


def extended(at: np.ndarray, phrase: np.ndarray, places: np.ndarray, word: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of phrases' positions, moved by their ``length``, with words' postings;
    both are in order of positions.  Position, phrase and following word."""
    if not len(places):
        return at[:0], phrase[:0], word[:0]
    i = np.minimum(np.searchsorted(places, at + length), len(places) - 1)
    hit = places[i] == at + length
    return at[hit], phrase[hit], word[i[hit]]


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal rows: the first's place, their sum, and for each row which of these it is."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0], of


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _in_groups(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of a batch with one value of a column."""
    v = b.column(column).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), len(v)] if len(v) else [0]
    for i, j in zip(edges, edges[1:], strict=False):
        yield int(v[i]), b.slice(i, j - i)


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """All rows of each value, of batches in order of the column."""
    at, held = None, []
    for b in batches:
        for value, some in _in_groups(b, column):
            if held and value != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = value
            held.append(some)
    if held:
        yield at, pa.Table.from_batches(held)


def _flat(t: pa.Table, column: str) -> np.ndarray:
    """All items of a column of arrays."""
    return t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _of_row(t: pa.Table, column: str) -> np.ndarray:
    """The number of items in each row."""
    return np.diff(t.column(column).combine_chunks().offsets.to_numpy()).astype(np.int64)


def _slices(where: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
    for i, j in zip(edges, edges[1:], strict=False):
        yield int(where[order[i]]), [c[order[i:j]] for c in columns]


_BLOCKS = "block long, slice int, lang string, words array<string>, n array<int>, place array<int>, sizes array<int>, gaps array<int>"
_WORDS = "block long, id array<long>, place array<int>, lang array<string>, word array<string>, f array<long>"
_TUPLES = "block long, slice int, u array<long>, v array<long>, w array<long>, n array<int>"
_FREQUENT = "block long, u array<long>, v array<long>, w array<long>, f array<long>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    of = lambda t: pa.list_(kinds[t[6:-1]]) if t.startswith("array<") else kinds[t]
    return pa.schema([(c.split()[0], of(c.split()[1])) for c in schema.split(", ")])


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    made = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in made], schema=made)


def _blocks(docs: DataFrame, slices: int) -> DataFrame:
    """Each block's lists in one row, and its words in one row a slice and language."""
    most = BLOCK_BYTES

    def made(texts: list[bytes], langs: list[str], block: int) -> pa.RecordBatch:
        names = sorted(set(langs))
        of = {x: i for i, x in enumerate(names)}
        kind, words, sizes, at = _lists(texts, np.array([of[x] for x in langs], np.int64))
        rows = [{"block": block, "sizes": sizes, "gaps": _gaps(sizes, at)}] if len(sizes) else []
        seeds = [xxhash.xxh64_intdigest(x) for x in names]
        dealt = np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) % slices for w, k in zip(words.to_pylist(), kind.tolist(), strict=True)), np.int64, len(kind))
        for where, (k, place, n) in _slices(dealt * len(names) + kind, [kind, np.arange(len(kind)), sizes]):
            rows.append({"block": block, "slice": where // len(names), "lang": names[k[0]], "words": words.take(pa.array(place)), "n": n, "place": place})
        return _rows(rows, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, langs, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                texts.append(raw)
                langs.append(lang)
                held += len(raw)
                if held >= most:
                    yield made(texts, langs, block)
                    block, texts, langs, held = block + 1, [], [], 0
        if texts:
            yield made(texts, langs, block)

    return docs.mapInArrow(common.task(run), _BLOCKS)


def _frequent_words(blocks: DataFrame, slices: int, least: int) -> DataFrame:
    """Numbers of frequent words for the blocks that have them, and (rows without a
    block) the words themselves; of each language the words of all occurrences, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in _grouped(batches, "slice"):
            size = _of_row(t, "n")
            block = np.repeat(t.column("block").to_numpy(), size)
            names = t.column("lang").combine_chunks().dictionary_encode()
            lang = np.repeat(names.indices.to_numpy(), size).astype(np.int64)
            words = t.column("words").combine_chunks().flatten().dictionary_encode()
            place, n = _flat(t, "place"), _flat(t, "n").astype(np.int64)
            first, f, of = _summed([lang, words.indices.to_numpy().astype(np.int64)], n)
            often = np.flatnonzero(f >= least)
            ids = np.full(len(f), -1, np.int64)
            ids[often] = number + slices * np.arange(len(often))
            known, every = ids[of] >= 0, names.dictionary.to_pylist()
            total = np.bincount(lang, n, len(every)).astype(np.int64)
            some = first[often]
            rows = [{"id": ids[often], "lang": [every[i] for i in lang[some]], "word": words.dictionary.take(words.indices.take(pa.array(some))), "f": f[often]}, {"lang": every, "f": total}]
            yield _rows(rows, _WORDS)
            out = [{"block": b, "id": own, "place": at} for b, (own, at) in _slices(block[known], [ids[of][known], place[known]])]
            if out:
                yield _rows(out, _WORDS)

    return blocks.where("slice is not null").select("slice", "block", "lang", "words", "n", "place").repartition("slice").sortWithinPartitions("slice").mapInArrow(common.task(run), _WORDS)


def _tuples(blocks: DataFrame, words: DataFrame, slices: int, pairs: DataFrame | None = None) -> DataFrame:
    """Lengths of the lists of all pairs of frequent words; with frequent ``pairs`` those
    of their extensions by a word, where the last two words are frequent, too."""
    schema = "block long, kind int, sizes array<int>, gaps array<int>, place array<int>, id array<long>, v array<long>"
    null = lambda t: F.lit(None).cast(t)
    ints, longs = "array<int>", "array<long>"
    rows = blocks.where("sizes is not null").select("block", F.lit(0).alias("kind"), "sizes", "gaps", null(ints).alias("place"), null(longs).alias("id"), null(longs).alias("v"))
    rows = rows.unionByName(words.where("block is not null").select("block", F.lit(1).alias("kind"), null(ints).alias("sizes"), null(ints).alias("gaps"), "place", "id", null(longs).alias("v")))
    if pairs is not None:
        rows = rows.unionByName(pairs.where("block is not null").select("block", F.lit(2).alias("kind"), null(ints).alias("sizes"), null(ints).alias("gaps"), null(ints).alias("place"), F.col("u").alias("id"), "v"))
    columns, longer = [c.split()[0] for c in schema.split(", ")], pairs is not None

    def part(t: pa.Table, kind: int) -> pa.Table:
        return t.filter(pa.array(t.column("kind").to_numpy() == kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _grouped(batches, "block"):
            lists, named = part(t, 0), part(t, 1)
            if not len(named):
                continue
            sizes, gaps = _flat(lists, "sizes").astype(np.int64), _flat(lists, "gaps").astype(np.int64)
            ids = np.full(len(sizes), -1, np.int64)
            ids[_flat(named, "place")] = _flat(named, "id")
            own = np.repeat(ids, sizes)
            known = own >= 0
            at = _positions(sizes, gaps)[known]
            order = np.argsort(at)
            # Words by their rank among the block's frequent ones.
            every = np.sort(ids[ids >= 0])
            at, word = at[order], np.searchsorted(every, own[known][order])
            width = len(every)
            place, first, second = extended(at, word, at, word, 1)
            pair = first * width + second
            if not longer:
                code, n = _counted(pair)
                u, v = every[code // width], every[code % width]
                w = np.zeros(0, np.int64)
                dealt = mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64))
            else:
                frequent = part(t, 2)
                if not len(frequent):
                    continue
                codes = np.sort(np.searchsorted(every, _flat(frequent, "id")) * width + np.searchsorted(every, _flat(frequent, "v")))
                often = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
                some = codes[often] == pair
                place, often, second = place[some], often[some], second[some]
                # The pair that begins one word on brings the third word.
                _, start, after = extended(place, often, place, second, 1)
                code, n = _counted(start * width + after)
                both, third = np.divmod(code, width)
                u, v, w = every[codes[both] // width], every[codes[both] % width], every[third]
                dealt = mix(mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64)) + w.astype(np.uint64))
            made = []
            for where, cut in _slices((dealt % np.uint64(slices)).astype(np.int64), [u, v, n, *([w] if len(w) else [])]):
                made.append({"block": block, "slice": where, "u": cut[0], "v": cut[1], "n": cut[2], "w": cut[3] if len(cut) > 3 else None})
            if made:
                yield _rows(made, _TUPLES)

    return rows.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(common.task(run), _TUPLES)


def _frequent_tuples(tuples: DataFrame, least: int, words: int) -> DataFrame:
    """Frequent phrases (rows without a block) and, of pairs, which blocks have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _grouped(batches, "slice"):
            block = np.repeat(t.column("block").to_numpy(), _of_row(t, "n"))
            keys = [_flat(t, c) for c in ("u", "v", "w")[:words]]
            first, f, of = _summed(keys, _flat(t, "n").astype(np.int64))
            often = f >= least
            if not often.any():
                continue
            some = first[often]
            yield _rows([{"f": f[often]} | {c: k[some] for c, k in zip("uvw", keys, strict=False)}], _FREQUENT)
            known = often[of]
            if words == 2:
                yield _rows([{"block": b, "u": u, "v": v} for b, (u, v) in _slices(block[known], [k[known] for k in keys])], _FREQUENT)

    return tuples.repartition("slice").sortWithinPartitions("slice").mapInArrow(common.task(run), _FREQUENT)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """From ``docs`` (lang, text): words (``id``, ``lang``, ``word``, ``f``), pairs (``u``,
    ``v``, ``f``) and triples (``u``, ``v``, ``w``, ``f``) that occur ``least`` times, all
    word occurrences (``lang``, ``n``), and the written tables that these read."""
    common.ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), common.text_or_empty().alias("text")).where("text <> ''")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(SLICES, -(-size // SLICE_BYTES))
    blocks = common.written(_blocks(own, slices), "phrase_blocks")
    named = common.written(_frequent_words(blocks, slices, least), "phrase_words")
    pairs = common.written(_frequent_tuples(_tuples(blocks, named, slices), least, 2), "phrase_pairs")
    triples = common.written(_frequent_tuples(_tuples(blocks, named, slices, pairs), least, 3), "phrase_triples")
    whole = named.where("block is null")
    words = whole.where("id is not null").select(F.explode(F.arrays_zip("id", "lang", "word", "f")).alias("x")).select("x.*")
    total = whole.where("id is null").select(F.explode(F.arrays_zip("lang", "f")).alias("x")).groupBy(F.col("x.lang").alias("lang")).agg(F.sum("x.f").alias("n"))
    two = pairs.where("block is null").select(F.explode(F.arrays_zip("u", "v", "f")).alias("x")).select("x.*")
    three = triples.select(F.explode(F.arrays_zip("u", "v", "w", "f")).alias("x")).select("x.*")
    common.discard(blocks)
    return words, two, three, total, [named, pairs, triples]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's
    first ``top`` phrases.  Products are decimals of 38 digits, enough for 10^15 words."""
    words, two, three, total, kept = phrase_counts(docs, least)
    big = lambda c: F.col(c).cast("decimal(15,0)")

    def score(a: str, left: str, right: str):
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))

    def word(letter: str, *columns: str):
        return words.select(F.col("id").alias(letter), *(F.col(c).alias(f"{c}_{letter}") for c in columns))

    longer = three.select("u", "v", "f").unionByName(three.select(F.col("v").alias("u"), F.col("w").alias("v"), "f")).groupBy("u", "v").agg(F.max("f").alias("longest"))
    alone = two.join(longer, ["u", "v"], "left").where(F.coalesce(100 * F.col("longest") < inside * F.col("f"), F.lit(True)))
    pairs = alone.join(word("u", "lang", "word", "f"), "u").join(word("v", "word", "f"), "v")
    pairs = pairs.select(F.col("lang_u").alias("lang"), F.concat_ws(" ", "word_u", "word_v").alias("phrase"), F.col("f").alias("a"), F.col("f_u").alias("l"), F.col("f_v").alias("r"))
    pairs = pairs.select("*", score("a", "l", "r").alias("score"))
    start, end = two.select("u", "v", F.col("f").alias("f_uv")), two.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("f").alias("f_vw"))
    cuts = three.join(start, ["u", "v"]).join(end, ["v", "w"]).join(word("u", "lang", "word", "f"), "u").join(word("v", "word"), "v").join(word("w", "word", "f"), "w")
    cut = lambda k, left, right: F.struct(score("f", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    triples = cuts.select(F.col("lang_u").alias("lang"), F.concat_ws(" ", "word_u", "word_v", "word_w").alias("phrase"), F.col("f").alias("a"), F.least(cut(1, "f_u", "f_vw"), cut(2, "f_uv", "f_w")).alias("c"))
    triples = triples.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = pairs.unionByName(triples).withColumn("rank", rank).where(F.col("rank") <= top)
    out = common.written(best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    common.discard(*kept)
    return out


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLES = {
    "op11_phrases": rf"""
with pieces as (select row_number() over () as piece, lang, x from (
  select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as x from documents)),
cut as (select piece, lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
words as (select piece, lang, unnest(ws) as u, generate_subscripts(ws, 1) as i from cut),
after as (select *, lead(u, 1) over t as v, lead(u, 2) over t as w from words window t as (partition by piece order by i)),
one as (select lang, u, count(*) as f from words group by all),
two as (select lang, u, v, count(*) as f from after where v is not null group by all),
three as (select lang, u, v, w, count(*) as f from after where w is not null group by all having count(*) >= {LEAST}),
total as (select lang, count(*) as n from words group by lang),
longer as (select lang, u, v, max(f) as longest from (select lang, u, v, f from three union all select lang, v, w, f from three) group by all),
pairs as (select t.lang, concat(t.u, ' ', t.v) as phrase, t.f as a, x.f as l, y.f as r, (1000000::hugeint * t.f * t.f // (x.f::hugeint * y.f))::bigint as score
  from two t join one x on (x.lang, x.u) = (t.lang, t.u) join one y on (y.lang, y.u) = (t.lang, t.v) left join longer g on (g.lang, g.u, g.v) = (t.lang, t.u, t.v) where t.f >= {LEAST} and coalesce(100 * longest < {INSIDE} * t.f, true)),
cuts as (select t.lang, concat(t.u, ' ', t.v, ' ', t.w) as phrase, t.f as a, x.f as l1, b.f as r1, (1000000::hugeint * t.f * t.f // (x.f::hugeint * b.f))::bigint as s1, c.f as l2, y.f as r2, (1000000::hugeint * t.f * t.f // (c.f::hugeint * y.f))::bigint as s2
  from three t join one x on (x.lang, x.u) = (t.lang, t.u) join two b on (b.lang, b.u, b.v) = (t.lang, t.v, t.w) join two c on (c.lang, c.u, c.v) = (t.lang, t.u, t.v) join one y on (y.lang, y.u) = (t.lang, t.w)),
every as (select * from pairs union all select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from cuts)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every) join total using (lang) where rank <= {TOP}"""
}
QUERIES = {"op11_phrases": op11_phrases}
