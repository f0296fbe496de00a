"""Sentence boundaries from the statistics of a corpus: which words end in a period though no sentence does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh_folder

#: Published values of the method: chance of a period behind an abbreviation, least scores of abbreviations and of words
#: that begin sentences.
CHANCE, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
#: Kinds of words that are learned.
SHORT, FIRST = "abbreviation", "starter"
#: A mark that no text keeps.
MARK = "\x01"


def bare(token: Column) -> Column:
    """A token in lower case without quotes, brackets and the like around it; periods at its end stay."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def base(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "")


def tokens(docs: DataFrame) -> DataFrame:
    """(word, next): each token of docs (text) as bare(), and the one behind it; those without letters are empty."""
    all_ = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)), bare)
    own = F.transform(all_, lambda x: F.when(x.rlike(r"\p{L}"), x).otherwise(""))
    pairs = F.transform(F.col("own"), lambda x, i: F.struct(x.alias("word"), F.get("own", i + 1).alias("next")))
    return docs.select(own.alias("own")).select(F.explode(pairs).alias("x")).select("x.*")


def counted(found: DataFrame) -> DataFrame:
    """(word, next, n) of tokens(): each pair once, with its count. All else is reckoned from this table, which is written
    to the shared folder, so that texts are cut into tokens once."""
    folder = fresh_folder(found.sparkSession, "tokens")
    own = found.groupBy("word", "next").agg(F.count("*").alias("n"))
    own.write.parquet(folder)
    return found.sparkSession.read.schema(own.schema).parquet(folder)


def _with_counts(found: DataFrame) -> DataFrame:
    return found if "n" in found.columns else found.withColumn("n", F.lit(1).cast("long"))


def abbreviations(found: DataFrame, least: float = ABBREVIATION) -> DataFrame:
    """(word, score) of words that a period mostly follows, from tokens() or counted().

    The log-likelihood ratio of "a period nearly always follows" against "periods come as they do", times weights for
    short words, inner periods, and against occurrences without a period. Words are counted over the whole corpus with
    partial aggregates; the totals are two numbers."""
    found, dotted = _with_counts(found), F.coalesce(F.sum(F.when(F.col("word").endswith("."), F.col("n"))), F.lit(0))
    own = found.where("word <> ''").groupBy(base(F.col("word")).alias("word")).agg(F.sum("n").alias("n"), dotted.alias("dots")).where("word <> ''")
    n, dots = found.agg(F.sum("n"), dotted).first()
    if not dots:
        return own.select("word", F.lit(0.0).alias("score")).limit(0)
    p, rest = min(dots / n, 1 - 1e-9), F.col("n") - F.col("dots")
    ratio = 2 * (F.col("dots") * F.log(F.lit(CHANCE)) + rest * F.log(F.lit(1 - CHANCE)) - F.col("dots") * F.log(F.lit(p)) - rest * F.log(F.lit(1 - p)))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = F.length("word") - inner
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size, -rest)
    return own.where("dots > 0").select("word", score.alias("score")).where(F.col("score") >= least)


def starters(found: DataFrame, known: DataFrame, least: float = STARTER) -> DataFrame:
    """(word, score) of words that begin sentences more often than they occur, by the log-likelihood ratio of their
    counts behind periods that belong to no abbreviation of `known`."""
    found = _with_counts(found)
    ends = found.where(F.col("word").endswith(".")).withColumn("key", base(F.col("word"))).join(known.select(F.col("word").alias("key")), "key", "left_anti")
    at = ends.where("next <> ''").groupBy(base(F.col("next")).alias("word")).agg(F.sum("n").alias("at"))
    own = found.where("word <> ''").groupBy(base(F.col("word")).alias("word")).agg(F.sum("n").alias("n")).join(at, "word")
    total, breaks = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (found, ends))
    log = lambda k, m, p: k * F.log(p) + (m - k) * F.log(1 - p)
    near = lambda x: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), x))
    n, at_, b = F.col("n"), F.col("at"), F.lit(breaks)
    p, p1, p2 = near(n / total), near(at_ / b), near((n - at_) / F.lit(max(total - breaks, 1)))
    score = 2 * (log(at_, b, p1) + log(n - at_, F.lit(total - breaks), p2) - log(at_, b, p) - log(n - at_, F.lit(total - breaks), p))
    return own.where((at_ / b) > (n / total)).select("word", score.alias("score")).where(F.col("score") >= least)


def learned(docs: DataFrame) -> DataFrame:
    """(kind, word): all abbreviations and starters of docs (text), as a table in the shared folder."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "words")
    found = counted(tokens(docs))

    def stored(words: DataFrame, kind: str) -> DataFrame:
        words.select(F.lit(kind).alias("kind"), "word").write.parquet(f"{folder}/{kind}")
        return spark.read.schema("kind string, word string").parquet(f"{folder}/{kind}")

    known = stored(abbreviations(found), SHORT)
    return known.unionByName(stored(starters(found, known), FIRST))


def learn(docs: DataFrame) -> tuple[list[str], list[str]]:
    """(abbreviations, starters) of docs (text) as split() takes them. These are all of learned() in the driver; a large
    corpus is split by split_rows()."""
    rows = learned(docs).collect()
    return tuple(sorted(r.word for r in rows if r.kind == kind) for kind in (SHORT, FIRST))


def _parts(text: Column | str) -> Column:
    return F.regexp_extract_all(F.translate(F.col(text) if isinstance(text, str) else text, MARK, " "), F.lit(r"\s*\S+"), F.lit(0))


def _end(x: Column) -> Column:
    """The mark that a token ends in, if any."""
    return F.regexp_extract(x, r"([.!?])[\"'»”’)\]]*$", 1)


def _capital(x: Column) -> Column:
    return x.rlike(r"^\s*[^\p{L}\p{N}]*\p{Lu}")


def asked(text: Column | str) -> Column:
    """The (kind, word) that split() looks up for a text, each once."""

    def each(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(all_, i + 1), F.lit(""))
            own = F.struct(F.lit(SHORT).alias("kind"), base(bare(x)).alias("word"))
            then = F.when(_capital(after), F.struct(F.lit(FIRST).alias("kind"), base(bare(after)).alias("word")))
            return F.when(x.contains(".") & (_end(x) == "."), F.array(own, then))

        found = F.flatten(F.filter(F.transform(all_, one), lambda x: x.isNotNull()))
        return F.array_distinct(F.filter(found, lambda x: x["word"] != ""))

    return F.get(F.transform(F.array(_parts(text)), each), F.lit(0))


def split_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (text, ...) with `s`, their sentences as split() has them by known (kind, word), of any length.

    What a text must know is joined with known, so that no list of words is held whole anywhere: a row gets only those
    known words that its own text asks for. Rows are numbered and written first, as neither ids nor texts need differ."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "numbered")
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    numbered = spark.read.schema(numbered.schema).parquet(folder)
    wanted = numbered.select("_row", F.explode(asked("text")).alias("x")).select("_row", "x.*")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("word"))).alias(kind)
    own = wanted.join(known, ["kind", "word"], "left_semi").groupBy("_row").agg(of(SHORT), of(FIRST)).select("_row", F.struct(SHORT, FIRST).alias("_known"))
    words = tuple(F.coalesce(F.col("_known")[kind], F.array().cast("array<string>")) for kind in (SHORT, FIRST))
    return numbered.join(own, "_row", "left").withColumn("s", split("text", words)).drop("_row", "_known")


def split(text: Column | str, known: tuple[list[str] | Column, list[str] | Column] = ((), ())) -> Column:
    """The sentences of a text, in order; put together they are the text, but for white space at its end and for a
    control character that counts as a space.

    A sentence ends behind ! or ?, and behind a period unless the word before it is an abbreviation; behind one, only if
    a capital letter follows that begins a word which is known to start sentences. Quotes and brackets behind the mark
    belong to it. Null gives null, a blank text no sentence. The words of `known` are lists, or columns of arrays.
    """
    short, first = known

    def is_in(x: Column, words: list[str] | Column) -> Column:
        if isinstance(words, Column):
            return F.array_contains(words, x)
        return x.isin(list(words)) if words else F.lit(False)

    def ended(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(all_, i + 1), F.lit(""))
            goes_on = is_in(base(bare(x)), short) & ~(_capital(after) & is_in(base(bare(after)), first))
            may = x.contains(".") | x.contains("!") | x.contains("?")  # most words end nothing, and a look is cheap
            return F.concat(x, F.when(may & (_end(x) != "") & ~((_end(x) == ".") & goes_on), MARK).otherwise(""))

        return F.filter(F.split(F.array_join(F.transform(all_, one), ""), MARK), lambda s: s != "")

    return F.get(F.transform(F.array(_parts(text)), ended), F.lit(0))
