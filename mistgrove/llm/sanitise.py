"""Personal data by patterns, and the words around it that give it away, by what the corpus says about them.

A protected entity is what the patterns find. For a word t and an entity e, counted over documents: N all, n(e) that hold e,
n(t) that hold t, n(t, e) that hold t within NEAR words of e. Seeing t tells log2(N n(t, e) / (n(t) n(e))) of the
log2(N / n(e)) bits of e, so log2(n(t) / n(t, e)) bits stay hidden. Words that leave few bits hidden, as two different
passages at least bear out, are removed, and those that leave some more are generalised, wherever they stand.

DataFrame functions only. The patterns are those of the definition, written so that a search never goes back over
what it has read: a match begins where a run of its characters does, and what can't be given back is possessive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.llm.common import ascii_lower, stored

# The kinds with their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = (*PATTERNS, "remove", "generalise")

#: A word that may give something away: a letter, then letters and digits; A-Z count as a-z.
TERM = r"\p{L}[\p{L}\p{N}]*+"
#: Words to either side of an entity that count as near; different passages that must bear a pair out.
NEAR, PASSAGES = 8, 2
#: Bits of an entity left hidden by a word that is removed, and by one that is generalised; bits a word must tell at all.
REMOVE_BITS, GENERALISE_BITS, TOLD_BITS = 1.0, 3.0, 4.0
#: Lists of at most so many words are sent to every task, longer ones are joined.
BROADCAST_WORDS = 500_000


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn sum."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def accepted(kind: Column, found: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    length = F.length(digits(found))
    return (F.when(kind == "ip", found.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
            .when(kind == "card", length.between(16, 19) & luhn(digits(found)))
            .when(kind == "phone", length.between(8, 15)).otherwise(True))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def broken(text: Column, pattern: Column, found: Column) -> Column:
    """The matches as an array of (before, found, after): each with the text since the match before it and up to the next."""
    between = F.split(text, pattern, -1)
    return F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("before"), b.alias("found"))),
                      F.slice(between, F.lit(2), F.size(found)),
                      lambda x, after: F.struct(x["before"].alias("before"), x["found"].alias("found"), after.alias("after")))


def placed(opened: DataFrame, *by: str) -> DataFrame:
    """Add start and end (code points) to matches in the order `i`, from the lengths `gap` before and `length` of each."""
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return opened.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).drop("gap", "length", "i")


def base_matches(rows: DataFrame) -> DataFrame:
    """Columns row, kind, start, end, entity, near (words around it) of the matches that hold."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"found_{k}").alias("found"), F.when(F.size(f"found_{k}") > 0, broken(
        F.col("text"), F.lit(p), F.col(f"found_{k}"))).alias("parts")) for k, p in PATTERNS.items()])
    some = rows.where(" or ".join(f"size(found_{k}) > 0" for k in PATTERNS))
    each = some.select("row", F.explode(kinds).alias("k")).where("k.parts is not null").select("row", "k.kind", F.posexplode("k.parts").alias("i", "x"))
    holds = accepted(F.col("kind"), F.col("x.found"))
    entity = F.when(F.col("kind").isin("card", "phone"), digits(F.col("x.found"))).otherwise(ascii_lower(F.col("x.found")))
    before, after = terms(F.col("x.before")), terms(F.col("x.after"))
    left = F.slice(before, F.greatest(F.lit(1), F.size(before) - (NEAR - 1)), F.lit(NEAR))
    near = F.transform(F.concat(left, F.slice(after, 1, NEAR)), ascii_lower)
    opened = each.select("row", "kind", "i", F.char_length("x.before").alias("gap"), F.char_length("x.found").alias("length"), holds.alias("holds"),
                         F.when(holds, entity).alias("entity"), F.when(holds, near).alias("near"))
    return placed(opened, "row", "kind").where("holds").drop("holds")


def holding(rows: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """Columns row, word: which rows hold which of the given different words."""
    each = rows.select("row", F.explode(F.array_distinct(F.transform(terms(F.col("text")), ascii_lower))).alias(column))
    return each.join(F.broadcast(words) if words.count() <= BROADCAST_WORDS else words, column)


def disclosures(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Columns word, kind, entity, told, hidden: pairs borne out by PASSAGES passages, with the bits told and left hidden."""
    total = rows.count()
    entities = found.groupBy("kind", "entity").agg(F.count_distinct("row").alias("n_entity"))
    each = found.select("row", "kind", "entity", F.md5(F.concat_ws(" ", "near").cast("binary")).alias("passage"), F.explode(F.array_distinct("near")).alias("word"))
    pairs = each.groupBy("word", "kind", "entity").agg(F.count_distinct("row").alias("n_pair"), F.count_distinct("passage").alias("passages")).where(F.col("passages") >= PASSAGES)
    pairs = stored(pairs.join(entities, ["kind", "entity"]), "private-pairs")
    words = stored(pairs.select("word").distinct(), "private-words")
    counts = holding(rows, words).groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    told = F.log2(F.lit(float(total)) * F.col("n_pair") / (F.col("n_word") * F.col("n_entity")))
    return pairs.join(counts, "word").select("word", "kind", "entity", F.round(told, 9).alias("told"), F.round(F.log2(F.col("n_word") / F.col("n_pair")), 9).alias("hidden"))


def revealing(pairs: DataFrame) -> DataFrame:
    """Columns word, kind (remove or generalise) of the words that disclose too much about any entity."""
    least = pairs.where(F.col("told") >= TOLD_BITS).groupBy("word").agg(F.min("hidden").alias("hidden")).where(F.col("hidden") <= GENERALISE_BITS)
    return least.select("word", F.when(F.col("hidden") <= REMOVE_BITS, "remove").otherwise("generalise").alias("kind"))


def word_matches(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Columns row, kind, start, end of every occurrence of the words."""
    rows_with = holding(rows, words).select("row").distinct()
    found = terms(F.col("text"))
    parts = broken(F.col("text"), F.lit(TERM), found)
    opened = rows.join(rows_with, "row").select("row", F.posexplode(parts).alias("i", "x")).select(
        "row", "i", F.char_length("x.before").alias("gap"), F.char_length("x.found").alias("length"), ascii_lower(F.col("x.found")).alias("word"))
    return placed(opened, "row").join(F.broadcast(words) if words.count() <= BROADCAST_WORDS else words, "word").select("row", "kind", "start", "end")


def personal_spans(rows: DataFrame) -> DataFrame:
    """Columns row, kind, start, end: the patterns' matches, and the words that give them away outside of them."""
    found = stored(base_matches(rows), "private-base")
    words = stored(revealing(disclosures(rows, found)), "private-revealing")
    base = found.select("row", "kind", "start", "end")
    if words.isEmpty():
        return base
    both = base.unionByName(word_matches(rows, words))
    extra = F.col("kind").isin("remove", "generalise")
    upto = Window.partitionBy("row").orderBy("start", extra)
    inside = F.max(F.when(~extra, F.col("end"))).over(upto) > F.col("start")
    return both.withColumn("inside", extra & F.coalesce(inside, F.lit(False))).where("not inside").drop("inside")


def read_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns row, key, text (null: empty) and the matches of every pattern; stored, so that row stays the same."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(read.select("row", "key", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"found_{k}") for k, p in PATTERNS.items()]), "private-rows")


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, n_remove, n_generalise, base_sha256, spans.

    Spans are kind:start:end in code points, by kind and start; base_sha256 is of those of the four patterns alone. Null and empty
    texts have none (the digest of empty text); repeated rows give repeated rows, and count each in the statistics; an
    empty table gives an empty one; other columns are not looked at. Texts are read whole.
    """
    rows = read_rows(docs, key, text)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = personal_spans(rows).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(number.alias("no"), "start", "end", "kind"))).alias("s"))
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: lambda x: x["kind"] == k
    told = listed.select("row", *[F.size(F.filter("s", of(k))).alias(f"n_{k}") for k in KINDS],
                         shown(F.filter("s", lambda x: x["no"] <= len(PATTERNS))).alias("base"), shown(F.col("s")).alias("spans"))
    out = rows.select("row", "key").join(told, "row", "left")
    return out.select(F.col("key").alias(key), *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, text with every span replaced: [email] and the like for matches, [...] for removed words, [word] for generalised ones.

    Of overlapping spans the first, and of one start the longest, is replaced, and the others as far as they go beyond it. Null texts are empty.
    """
    rows = read_rows(docs, key, text)
    shown = F.when(F.col("kind") == "remove", "[...]").when(F.col("kind") == "generalise", "[word]").otherwise(F.concat(F.lit("["), "kind", F.lit("]")))
    in_row = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind")
    done = F.coalesce(F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = personal_spans(rows).withColumn("done", done).where("end > done").select("row", F.greatest("start", "done").alias("start"), "end", "done", shown.alias("shown"))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "done", "shown"))).alias("s"))
    told = rows.select("row", "key", "text").join(listed, "row", "left")
    cut = F.transform("s", lambda x: F.concat(F.substring(F.col("text"), x["done"].cast("int") + 1, (x["start"] - x["done"]).cast("int")), x["shown"]))
    rest = F.substring(F.col("text"), F.element_at("s", -1)["end"].cast("int") + 1, F.char_length("text"))
    return told.select(F.col("key").alias(key), F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(cut, ""), rest)).alias("text"))
