"""Secret scanning with a random forest against false positives.

Two wide patterns find candidates: runs of key characters with a digit, and whatever is assigned to a name with a word such
as password or token in it, of any characters, quoted or up to white space. What tells a secret from a card number, a path or a long
name is left to a random forest over the candidate's length, the transitions between its characters, how much of it
consists of frequent words of the corpus, whether it stands in a path, and the words beside it. The forest is trained on
labelled findings, a bounded sample of them (``max_rows``), and scores every candidate of every whole text.

Everything is DataFrame functions and Spark's own forest; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import frozen, text_or_empty

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}"
#: Words beside a candidate that name it.
HINTS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "auth", "bearer", "credential")
#: A name with such a word in it and what assigns it a value, up to the value; then that value.
NAMED = r"(?i:(?:" + "|".join(HINTS) + r")[\w.\]-]*+[\"']?+\s{0,3}+[:=]>?+\s{0,3}+[\"']?+|bearer\s{1,3}+)"
ASSIGNED = NAMED + r"""(?:(?<=")[^"\r\n]+(?=")|(?<=')[^'\r\n]+(?=')|[^\s"']\S*)"""
AROUND = 40
LETTERS, DIGITS = "A-Za-z", "0-9"
FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "symbol_share", "to_other_class", "letter_digit", "case_change", "distinct_share",
    "vowel_share", "hex_only", "digits_only", "dictionary", "in_path", "after_equals", "quoted", "hint_before",
    "hint_after", "digit_before", "digit_after",
)


def _found(texts: DataFrame, pattern: str) -> DataFrame:
    """(row, doc_id, start, match, before, after): every match, with the text on both sides."""
    cut = texts.filter(F.col("text").rlike(pattern)).select(
        "row", "doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"),
        F.split("text", pattern, -1).alias("between"),
    )
    # The pieces between matches tell where each begins, and hold the words beside it.
    beside = F.transform(
        "between", lambda x: F.struct(F.length(x).alias("n"), F.left(x, F.lit(AROUND)).alias("head"), F.right(x, F.lit(AROUND)).alias("tail"))
    )
    flat = cut.select("row", "doc_id", "found", beside.alias("b")).select(
        "row", "doc_id",
        F.posexplode(F.arrays_zip(
            F.col("found").alias("match"), F.slice("b", 1, F.size("found")).alias("l"), F.slice("b", 2, F.size("found")).alias("r")
        )).alias("n", "x"),
    )
    of_row = Window.partitionBy("row").orderBy("n")
    so_far = of_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A match has four characters or more, so this many neighbours hold the text around where pieces are short.
    reach = AROUND // 4
    earlier = F.concat_ws("", F.collect_list(
        F.concat(F.col("x.l.tail"), F.right("x.match", F.lit(AROUND)))
    ).over(of_row.rowsBetween(-reach, -1)))
    later = F.concat_ws("", F.collect_list(
        F.concat(F.left("x.match", F.lit(AROUND)), F.col("x.r.head"))
    ).over(of_row.rowsBetween(1, reach)))
    return flat.select(
        "row", "doc_id", F.col("x.match").alias("match"),
        (F.sum(F.col("x.l.n") + F.length("x.match")).over(so_far) - F.length("x.match")).cast("long").alias("start"),
        F.right(F.concat(earlier, F.col("x.l.tail")), F.lit(AROUND)).alias("before"),
        F.left(F.concat(F.col("x.r.head"), later), F.lit(AROUND)).alias("after"),
    )


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, n, start, candidate, before, after): every candidate of every text, with the text beside it.

    ``start`` counts characters from 0. Where a run and an assigned value begin at the same place, the longer is taken. A
    comma, semicolon or closing mark behind an unquoted value is not part of it. Null and empty texts have none. Stored, so
    that rows keep their numbers.
    """
    texts = frozen(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")
    ).filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED)), "texts")
    runs = _found(texts, CANDIDATE).withColumnRenamed("match", "candidate")
    named = _found(texts, ASSIGNED).withColumn("name", F.regexp_extract("match", "^" + NAMED, 0))
    value = F.expr("substring(match, length(name) + 1)")
    closed = F.col("name").rlike("\"$") & F.col("after").startswith("\"") | F.col("name").rlike("'$") & F.col("after").startswith("'")
    bare = F.regexp_replace(value, r"""[,;"')\]}]+$""", "")
    named = named.withColumn("candidate", F.when(closed, value).otherwise(bare)).filter("candidate <> ''")
    named = named.select(
        "row", "doc_id", (F.col("start") + F.length("name")).alias("start"), "candidate",
        F.right(F.concat("before", "name"), F.lit(AROUND)).alias("before"),
        F.left(F.concat(F.expr("substring(match, length(name) + length(candidate) + 1)"), "after"), F.lit(AROUND)).alias("after"),
    )
    both = runs.select(named.columns).unionByName(named)
    place = Window.partitionBy("row", "start").orderBy(F.desc(F.length("candidate")))
    one = both.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")
    n = F.row_number().over(Window.partitionBy("row").orderBy("start")) - 1
    return frozen(one.select("row", "doc_id", n.alias("n"), "start", "candidate", "before", "after"), "candidates")


def dictionary(docs: DataFrame, words: int = 5000, text_column: str = "text") -> DataFrame:
    """The most frequent words of four to eight letters, in lower case: (word). At most ``words`` rows of a few bytes."""
    word = F.explode(F.regexp_extract_all(F.lower(text_or_empty(text_column)), F.lit(r"\b[a-z]{4,8}\b"), F.lit(0)))
    counted = docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(words).select("word")


def _share(part: str) -> Column:
    """How much of the candidate is left when everything but ``part`` goes."""
    return F.length(F.regexp_replace("candidate", f"[^{part}]", "")) / F.length("candidate")


def _pairs(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.greatest(F.length("candidate") - 1, F.lit(1))


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the inputs of the forest; ``known`` is the dictionary."""
    hint = "(?i)(" + "|".join(HINTS) + ")"
    words = found.select("row", "n", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("run"))
    pieces = words.select("row", "n", F.explode(F.expr(
        "flatten(transform(sequence(4, least(8, length(run))), k -> transform(sequence(1, length(run) - k + 1), i -> substring(run, i, k))))"
    )).alias("word")).distinct()
    covered = pieces.join(known, "word").groupBy("row", "n").agg(F.sum(F.length("word")).alias("letters"))
    x = found.join(covered, ["row", "n"], "left")
    number = lambda condition: condition.cast("double")
    return x.withColumns(
        {
            "length": F.least(F.length("candidate"), F.lit(200)).cast("double"),
            "digit_share": _share(DIGITS), "upper_share": _share("A-Z"), "lower_share": _share("a-z"),
            "symbol_share": F.length(F.regexp_replace("candidate", "[A-Za-z0-9]", "")) / F.length("candidate"),
            "to_other_class": _pairs(r"(?<=[A-Z])(?=[^A-Z])|(?<=[a-z])(?=[^a-z])|(?<=[0-9])(?=[^0-9])"),
            "letter_digit": _pairs(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
            "case_change": _pairs(r"(?<=[a-z])(?=[A-Z])"),
            "distinct_share": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
            "vowel_share": _share("aeiouAEIOU"),
            "hex_only": number(F.col("candidate").rlike("^[0-9a-f]+$")),
            "digits_only": number(F.col("candidate").rlike("^[0-9_-]+$")),
            "dictionary": F.least(F.coalesce("letters", F.lit(0)) / F.length("candidate"), F.lit(1.0)),
            "in_path": number(F.col("before").rlike(r"(://|[./\\])\S*$") | F.col("candidate").contains("/")),
            "after_equals": number(F.col("before").rlike(r"[=:]\s*[\"']?$")),
            "quoted": number(F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")),
            "hint_before": number(F.col("before").rlike(hint)),
            "hint_after": number(F.col("after").rlike(hint)),
            "digit_before": number(F.col("before").rlike(r"[0-9]\S*\s?$")),
            "digit_after": number(F.col("after").rlike(r"^\s?\S*[0-9]")),
        }
    ).drop("letters")


def seed_findings(found: DataFrame) -> DataFrame:
    """Labels where no reviewed findings are at hand: (row, n, label) by forms that issuers and configuration files use.

    Secrets: AWS access key ids and values assigned to a name such as password or token. Others: plain numbers. Candidates of
    neither form have no label.
    """
    named = F.col("before").rlike(r"(?i)(password|passwd|secret|token|api_?key)\w*[\"']?\s*[=:]\s*[\"']?$")
    issued = F.col("candidate").rlike("^(AKIA|ASIA)[A-Z0-9]{16}$")
    label = F.when(named | issued, 1).when(F.col("candidate").rlike("^[0-9_+/-]+$"), 0)
    return found.select("row", "n", label.alias("label")).filter("label is not null")


def train(
    inputs: DataFrame, findings: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 11
) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (row, n, label), at most ``max_rows`` of each label in the order of a hash; None
    where one of the two labels is missing, since nothing tells them apart then.
    """
    marked = inputs.join(findings.filter(F.col("label").isin(0, 1)).dropDuplicates(["row", "n"]), ["row", "n"])
    order = F.xxhash64("candidate", "before", "after")
    some = marked.filter("label = 1").orderBy(order, "row", "n").limit(max_rows).unionByName(
        marked.filter("label = 0").orderBy(order, "row", "n").limit(max_rows)
    )
    some = frozen(some.select("label", *FEATURES), "findings")
    if some.select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2,
        featureSubsetStrategy="sqrt", cacheNodeIds=False,
    )
    return forest.fit(vector.transform(some.withColumn("label", F.col("label").cast("double"))))


def scan(
    docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_column: str = "doc_id",
    text_column: str = "text", max_rows: int = 20_000,
) -> DataFrame:
    """Every candidate of every text with its probability and whether it is reported: row, doc_id, start, length, candidate,
    score, is_secret.

    ``findings`` are reviewed findings (doc_id, start, label), label 1 for a secret; without them ``seed_findings`` labels
    those of known forms. Without findings of both kinds every candidate is reported, with a null score: nothing is removed
    as a false positive on no evidence. Repeated rows have findings of their own; null ids have no reviewed findings. Other
    columns play no part; an empty table gives an empty one.
    """
    found = candidates(docs, id_column, text_column)
    inputs = frozen(features(found, frozen(dictionary(docs, text_column=text_column), "dictionary")), "inputs")
    labelled = (
        seed_findings(found)
        if findings is None
        else found.join(findings.select("doc_id", "start", "label"), ["doc_id", "start"]).select("row", "n", "label")
    )
    model = train(inputs, labelled, max_rows)
    if model is None:
        scored = inputs.withColumn("score", F.lit(None).cast("double"))
    else:
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep")
        scored = model.transform(vector.transform(inputs)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "row", "doc_id", "start", F.length("candidate").alias("length"), "candidate", "score",
        F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("is_secret"),
    )
