"""Near-duplicate lines across all documents: exact set-similarity join on line tokens, in DataFrame functions only.

A line is the set of its lower-cased words. It is removed if an earlier line, by (doc_id, line number), has a
Jaccard similarity of at least ``percent``, whether that line itself stays or not.

1. Tokens are ordered by rarity: how often each is seen in all lines, in a table of 2**RARITY_BITS counters
   (a fixed size, so it may go to every task as one literal). Tokens that share a counter share its rank, which
   costs candidates but no result: any order that is the same for all lines is right.
2. Lines with equal sets become one, with the first position and the prefix of n - ceil(t n) + 1 rarest tokens.
3. Stars: lines that share neighbouring prefix tokens are compared with the first of them. That settles
   nearly all of a group of near copies without forming its pairs.
4. Prefix join of the unsettled lines with all earlier ones, with the length filter, the positional filter,
   a bound of the difference by odd sketches (128 parity bits of the tokens), and the number of shared prefix tokens.
5. Candidates are verified on the full sets, read again from the lines that hold them.

Defined cases: NULL texts stay NULL, lines without a word are kept, rows with a NULL doc_id are left as they
are and compared with nothing; rows that repeat a doc_id stand at the same positions, so lines at equal
positions do not remove each other; ties cannot occur otherwise; an empty table gives no rows; other
columns are handed on, whatever their names. Removing all lines leaves an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small, written
from .text import prefix, prefixed, unprefixed

PERCENT = 80
RARITY_BITS = 20
_GROUP_BITS = 10  # counters travel to the driver in so many groups
_SPACES = "\t\r\x0b\x0c"
_STAR_KEYS = 3  # pairs of neighbouring prefix tokens of a line
_RANK = 56  # bits of the hash kept below the rank


def _hashes(line: Column) -> Column:
    """Hashes of the words of a line, without the empty one between two blanks."""
    return F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _each_line(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, place, line: lower case, with blanks for other white space; and columns of the document handed on."""
    low = F.lower("text")
    odd = [F.contains(low, F.lit(c)) for c in _SPACES]
    plain = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(low, _SPACES, "    ")).otherwise(low)
    whole = docs.where("doc_id is not null and text is not null").select("doc_id", *carried, plain.alias("text"))
    return whole.select("doc_id", *carried, F.posexplode(F.split("text", "\n")).alias("place", "line"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, place, tokens of every line with a word."""
    return _each_line(docs).select("doc_id", "place", F.array_distinct(_hashes(F.col("line"))).alias("tokens")).where(F.size("tokens") > 0)


def _rarity(docs: DataFrame) -> bytearray:
    """One byte per counter: twice the logarithm of its count, as a character code from 1 on (1: at most one occurrence)."""
    counter = F.shiftrightunsigned("h", 64 - RARITY_BITS).cast("int")
    each = _each_line(docs).select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''").select(F.xxhash64("w").alias("h"))
    counts = each.groupBy(counter.alias("counter")).agg(F.count("*").alias("n")).where("n > 1")
    level = F.least(F.lit(100), F.lit(2) + F.floor(F.lit(2.0) * F.log2("n"))).cast("int")
    groups = counts.groupBy(F.shiftright("counter", RARITY_BITS - _GROUP_BITS).alias("g")).agg(F.collect_list(F.col("counter") * 128 + level).alias("levels"))
    table = bytearray(b"\x01") * (1 << RARITY_BITS)
    for row in groups.select("levels").toLocalIterator():
        for x in row.levels:
            table[x >> 7] = x & 127
    return table


def _rank(table: bytearray, h: Column) -> Column:
    at = F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int") + 1
    level = F.ascii(F.substring(F.lit(table), at, F.lit(1)).cast("string")).cast("long")
    return F.shiftleft(level, _RANK).bitwiseOR(h.bitwiseAND(F.lit((1 << _RANK) - 1)))


def _sketch(tokens: Column) -> Column:
    """Parities of how many tokens fall on each of 64 bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))


def _half(tokens: Column) -> Column:
    """The tokens of the first 64 of 128 bits; the parities of the others are those of all tokens with these taken off."""
    return F.filter(tokens, lambda h: h.bitwiseAND(F.lit(64)) == 0)


def _short(ranked: Column) -> Column:
    """Prefix tokens as 32-bit hashes, half as large; equal hashes of different tokens cost candidates only. 0: no other line has the token."""
    return F.transform(ranked, lambda r: F.when(F.shiftright(r, _RANK) > 1, F.hash(r)).otherwise(F.lit(0)))


def _described(lines: DataFrame, table: bytearray, percent: int) -> DataFrame:
    """Of every line: size, digest of its set, sketch and prefix."""
    n = F.size("tokens")
    length = n - F.floor((n * percent + 99) / 100).cast("int") + 1
    ranked = lines.select("doc_id", "place", n.alias("n"), _sketch(F.col("tokens")).alias("all"), _sketch(_half(F.col("tokens"))).alias("b"), F.sort_array(F.transform("tokens", lambda h: _rank(table, h))).alias("ranked"), length.alias("length"))
    return ranked.select("doc_id", "place", "n", F.xxhash64("ranked").alias("h1"), F.xxhash64("ranked", F.lit(7)).alias("h2"), "b", F.col("all").bitwiseXOR(F.col("b")).alias("b2"), _short(F.slice("ranked", F.lit(1), F.col("length"))).alias("prefix"))


def _sets(lines: DataFrame) -> DataFrame:
    """One row per distinct set: id in order of first position, how many lines have it."""
    first = lines.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "place", "b", "b2", "prefix")).alias("first"), F.count("*").alias("lines"))
    return first.select("first.*", "n", "h1", "h2", "lines").orderBy("doc_id", "place").withColumn("id", F.monotonically_increasing_id())


def _close(percent: int) -> Column:
    """Length filter and the bound by sketches, of a later line (n, b, b2) and an earlier one (m, c, c2)."""
    odd = F.bit_count(F.col("b").bitwiseXOR(F.col("c"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("c2")))
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sizes & (odd * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))


def _star_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Each line with the first line that shares neighbouring prefix tokens."""
    size = F.size("prefix")
    keys = F.transform(F.sequence(F.lit(1), F.least(F.greatest(size - 1, F.lit(1)), F.lit(2 * _STAR_KEYS - 1)), F.lit(2)), lambda i: F.xxhash64(F.get("prefix", i - 1), F.get("prefix", i)))
    keyed = sets.where("n > 3").select(F.explode(keys).alias("key"), "id")
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").select("key", "first")
    star = keyed.join(first, "key").where("id > first").select("id", "first").distinct()
    # both ends by id: sizes and sketches
    ends = sets.select("id", "n", "b", "b2")
    star = star.join(ends, "id").join(ends.select(F.col("id").alias("first"), F.col("n").alias("m"), F.col("b").alias("c"), F.col("b2").alias("c2")), "first")
    return star.where(_close(percent)).select("id", F.col("first").alias("other"))


def _prefix_pairs(sets: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Unsettled lines with every earlier line that passes the filters. Sets of up to three tokens can only be equal."""
    marked = sets.where("n > 3").join(small(settled, 8).withColumn("settled", F.lit(1)), "id", "left")
    entries = marked.select(F.posexplode("prefix").alias("i", "token"), "id", "n", "b", "b2", F.coalesce("settled", F.lit(0)).alias("settled"))
    entries = entries.where("token <> 0").select("token", "id", "b", "b2", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("settled").cast("long")).alias("about"))
    # renamed above the join only: both sides are the same plan, so that one shuffle serves both
    x, y = entries.alias("x"), entries.alias("y")
    def end(side: str, names: dict[str, str]) -> list[Column]:
        about = F.col(f"{side}.about")
        parts = {"n": F.shiftright(about, 32), "i": F.shiftright(about.bitwiseAND(F.lit((1 << 32) - 1)), 1), "settled": about.bitwiseAND(F.lit(1))}
        return [parts.get(c, F.col(f"{side}.{c}")).cast("long").alias(name) for c, name in names.items()]

    names = {"i": "j", "id": "other", "n": "m", "b": "c", "b2": "c2", "settled": "other_settled"}
    columns = end("x", {c: c for c in names}) + end("y", names)
    met = x.join(y, F.col("x.token") == F.col("y.token")).select(*columns)
    shared = F.least("i", "j") + 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    positional = shared * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    open_ = 2 * F.col("settled") + F.col("other_settled") < 2  # the later line is not settled
    found = met.where((F.col("id") > F.col("other")) & open_ & positional & _close(percent))
    # each row is a token that both prefixes have; behind its prefix a line has ceil(t n) - 1 tokens left to share
    left = F.floor((F.greatest("n", "m") * percent + 99) / 100) - 1
    counted = found.groupBy("id", "other", "n", "m").agg(F.count("*").alias("common"))
    return counted.where((F.col("common") + left) * (100 + percent) >= percent * (F.col("n") + F.col("m"))).select("id", "other")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The ids of later lines whose pair holds on the full sets."""
    ends = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    wanted = written(sets.join(ends, "id", "left_semi").select("id", "doc_id", "place"))
    # only the wanted lines of a text are cut into tokens, and nothing else of it goes to a shuffle
    of_doc = written(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("place", "id")).alias("wanted")))
    texts = docs.join(small(of_doc, 64), "doc_id")
    here = F.filter("wanted", lambda w: w.place == F.col("place"))
    found = _each_line(texts, "wanted").select(here.alias("here"), "line").where(F.size("here") > 0).select(F.explode("here.id").alias("id"), "line")
    full = written(found.select("id", F.array_distinct(_hashes(F.col("line"))).alias("tokens")).where(F.size("tokens") > 0).dropDuplicates(["id"]))
    both = pairs.join(full, "id").join(full.select(F.col("id").alias("other"), F.col("tokens").alias("others")), "other")
    common = F.size(F.array_intersect("tokens", "others"))
    return both.where(common * (100 + percent) >= percent * (F.size("tokens") + F.size("others"))).select("id").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, place) of every line that goes; ``docs`` has columns doc_id and text."""
    docs = docs.select("doc_id", "text")
    lines = written(_described(_lines(docs), _rarity(docs), percent))
    sets = written(_sets(lines))
    star = written(_star_pairs(sets, percent))
    settled = written(_verified(star, sets, docs, percent))
    rest = written(_prefix_pairs(sets, settled, percent))
    gone = settled.unionByName(_verified(rest, sets, docs, percent)).distinct().withColumn("gone", F.lit(True))
    judged = sets.select("id", "lines", "n", "h1", "h2", F.col("doc_id").alias("first_doc"), F.col("place").alias("first_place"))
    judged = judged.join(small(written(gone), 8), "id", "left").where("gone or lines > 1").drop("id", "lines")
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("place") != F.col("first_place"))
    found = lines.select("doc_id", "place", "n", "h1", "h2").join(small(written(judged), 48), ["n", "h1", "h2"])
    return found.where(later | F.col("gone").isNotNull()).select("doc_id", "place")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows and columns of ``docs``, the text without the removed lines, plus n_lines and n_removed."""
    places = removed_lines(docs, percent).distinct().groupBy("doc_id").agg(F.collect_list("place").alias("removed_places"))
    own = prefixed(docs)
    id_, text = prefix("doc_id"), prefix("text")
    joined = own.join(small(written(places.withColumnRenamed("doc_id", id_)), 48), id_, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed_places", i)), "\n")
    n_lines = F.length(text) - F.length(F.translate(F.col(text), "\n", "")) + 1
    return joined.select(*[F.col(f"`{c}`") for c in own.columns if c != text], F.when(F.col("removed_places").isNull(), F.col(text)).otherwise(kept).alias(text),
                         F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed_places"), F.lit(0)).alias("n_removed"))


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pipeline form: the same rows and columns, without repeated lines."""
    return unprefixed(deduplicated(docs, percent), docs)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over all documents."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("own_doc_id").alias("doc_id"), F.col("own_text").alias("text"), F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"))


SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
t AS (SELECT doc_id, place, line, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda x: x <> ''))) AS s FROM l),
u AS (SELECT row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := place))) AS id, s, len(s) AS n, min(struct_pack(d := doc_id, p := place)) AS f FROM t WHERE len(s) > 0 GROUP BY s),
w AS (SELECT id, n, unnest(s) AS x FROM u),
c AS (SELECT x, count(*) AS c FROM w GROUP BY 1),
k AS (SELECT id, n, w.x, row_number() OVER (PARTITION BY id ORDER BY c, w.x) AS i FROM w JOIN c ON w.x = c.x),
p AS (SELECT * FROM k WHERE i <= n - (80 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id > b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT a FROM q JOIN u y ON y.id = q.a JOIN u z ON z.id = q.b WHERE 180 * len(list_intersect(y.s, z.s)) >= 80 * (y.n + z.n)),
r AS (SELECT t.doc_id, t.place, t.line, u.id IS NOT NULL AND (g.a IS NOT NULL OR struct_pack(d := t.doc_id, p := t.place) <> u.f) AS gone FROM t LEFT JOIN u ON t.s = u.s LEFT JOIN g ON g.a = u.id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') END AS text, count(r.place) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id, d.text
"""
