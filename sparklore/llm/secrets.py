"""Secret scans: a random forest removes false positives (op 4). DataFrame operations only.

Candidates are runs of 12 or more key-like characters, all of each word. Their features: length, kinds of characters and
how often the kind changes, how unlikely the transitions of characters are beside those of the corpus' words, which share of
the candidate known words cover, and, hashed, its path, its assignment name and the neighbouring words. The forest is trained
here on labelled findings; at most half of ``TRAIN_ROWS`` of each class, those with the smallest hashes, and both classes weigh the same.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import stored

#: Bound of the labelled rows that the forest is fitted on.
TRAIN_ROWS = 20_000
#: Labelled rows of a class are repeated to so many at least, so that every tree sees rare secrets; the weights are divided by it.
LEAST_ROWS = 16
TREES, DEPTH, HASHED = 24, 8, 128
#: A word is known if this many documents hold it.
KNOWN_DOCUMENTS = 3
THRESHOLD = 0.5
#: A name as the left side of an assignment: digits only in short groups at the end of a part, so no key looks like one.
_NAME = r"[A-Za-z_](?:[A-Za-z_.\-]|[0-9]{1,3}(?=[_.\-\"'=:]))*"
#: Groups 1 and 2: the name that the run is assigned to, if any, and the run. A name that = or : follows is no run; one or two = are
#: padding only where the value ends.
_RUN = (r"(?<![A-Za-z0-9+/_.\-À-ɏ])(?:(" + _NAME + r"|[A-Za-z_][A-Za-z0-9_.\-]{0,10})[\"']?[=:]+>?[\"'(\[<{]*)?"
        r"(?!" + _NAME + r"[\"']?(?::|=(?!=|\z)))(?!(?=[^=]*_)" + _NAME + r"=\z)"
        r"([A-Za-z0-9+/_.\-]{12,}+(?:={1,2}(?![^\"',;)\]}>&]))?)")
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|credential)s?"
SCALARS = ["length", "digits", "uppers", "distinct_chars", "changes", "surprise", "known", "hex"]
HASHED_COLUMNS = ["path", "name", "before2", "before", "after"]


def candidates(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, pos (number of the word, from 0), run, value, name, path, before2, before, after: one row per candidate.

    Null and empty texts have none. A word has as many candidates as it has values; ``run`` numbers them from 0. ``name`` is what the
    value is assigned to inside its word; neighbours are words in lower case, "" at the ends of a text. Rows that are repeated
    have repeated candidates. Whether a digit is among the characters is left to the forest.
    """
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.split(F.col(text), r"[\x20\x09-\x0D]+", -1).alias("ws"))

    def word(i: Column) -> Column:
        return F.when((i >= 0) & (i < F.size("ws")), F.lower(F.get("ws", i))).otherwise("")

    # Long words take their neighbours with them before they are exploded, so that no row carries the words of the document.
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0))), lambda i: F.length(F.get("ws", i)) >= 12)
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), F.get("ws", i).alias("word"), word(i - 2).alias("before2"),
                                                   word(i - 1).alias("before"), word(i + 1).alias("after")))
    rows = (cut.filter("ws IS NOT NULL").select("doc_id", "path", F.explode(found).alias("f"))
            .select("doc_id", F.col("f.pos").cast("long").alias("pos"), F.coalesce("path", F.lit("")).alias("path"), "f.before2", "f.before", "f.after",
                    *[F.regexp_extract_all("f.word", F.lit(_RUN), F.lit(g)).alias(c) for g, c in ((1, "names"), (2, "values"))]))
    return (rows.select("*", F.posexplode(F.arrays_zip("names", "values")).alias("run", "r"))
            .select("doc_id", "pos", F.col("run").cast("long").alias("run"), F.col("r.values").alias("value"),
                    F.lower("r.names").alias("name"), "path", "before2", "before", "after"))


def words_known(docs: DataFrame, text: str = "text", least: int = KNOWN_DOCUMENTS) -> DataFrame:
    """word, n: lower-case words of 4 or more letters a-z, and how many documents hold them, at least ``least``. Stored."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{4,}"), F.lit(0))))
    return stored(docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


def _kind(c: Column) -> Column:
    """A character as one of 38: a letter in lower case, a digit as "0" to "9", a sign as "-"."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "-")


def transitions(known: DataFrame) -> DataFrame:
    """pair, cost: minus the logarithm of how likely the second character follows the first; 38 x 38 pairs at most. Stored."""
    w = F.concat(F.lit("-"), "word", F.lit("-"))
    pairs = known.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).alias("pair"))
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    firsts = counts.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    return stored(counts.join(F.broadcast(firsts), F.substring("pair", 1, 1) == F.col("a"))
                  .select("pair", (-F.log((F.col("n") + 1.0) / (F.col("all") + 38.0))).alias("cost")))


#: Cost of a transition that no word has.
UNSEEN = 12.0


def with_features(found: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` (stored candidates) with the columns SCALARS. Equal values share their features, counted once."""
    v = F.col("value")
    values = stored(found.select("value").distinct())
    kinds = _kind(v)
    steps = (values.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length(v) - 1),
                                                         lambda i: F.substring(kinds, i, F.lit(2)))).alias("pair"))
             .groupBy("value", "pair").agg(F.count(F.lit(1)).alias("n"))
             .join(F.broadcast(pairs), "pair", "left")             # at most 38 x 38 rows
             .groupBy("value").agg((F.sum(F.col("n") * F.coalesce("cost", F.lit(UNSEEN))) / F.sum("n")).alias("surprise")))
    covered = (values.select("value", F.explode(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
               .join(known.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered")))
    n = F.length(v).cast("double")
    changes = F.regexp_count(v, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    measured = (values.join(steps, "value", "left").join(covered, "value", "left")
                .select("value", n.alias("length"), (F.regexp_count(v, F.lit("[0-9]")) / n).alias("digits"),
                        (F.regexp_count(v, F.lit("[A-Z]")) / n).alias("uppers"),
                        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct_chars"), (changes / n).alias("changes"),
                        F.coalesce("surprise", F.lit(UNSEEN)).alias("surprise"),
                        (F.coalesce("covered", F.lit(0)) / n).alias("known"),
                        v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double").alias("hex")))
    return found.join(stored(measured), "value")


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with ``secret``: 1 for findings of a certain format, 0 for certain non-secrets, else null.

    Certain secrets: access keys with a fixed prefix and length, and mixed digits and letters without words that are assigned to a
    password-like name. Certain non-secrets: numbers, addresses, versions, file names and words with a number, unless assigned to such a name.
    """
    v = F.col("value")
    named = F.col("name").rlike(NAMES) | (F.col("before").isin("=", ":") & F.col("before2").rlike(NAMES))
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(r"^[A-Za-z]+[0-9]{0,4}$")
    return found.withColumn("secret", F.when(v.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$") | (named & mixed), 1.0)
                            .when(~named & v.rlike(r"^[0-9+/_.\-]+$|^[A-Za-z]+[0-9]{0,4}$|^[a-z]+(?:[._/-][a-z0-9]+)+$"), 0.0))


def _vectors(rows: DataFrame) -> DataFrame:
    return FeatureHasher(inputCols=[*SCALARS, *HASHED_COLUMNS], categoricalCols=HASHED_COLUMNS, numFeatures=HASHED,
                         outputCol="features").transform(rows)


def classify(found: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS,
             seed: int = 7) -> DataFrame:
    """``found`` with score (0 to 1) and is_secret (score >= ``threshold``).

    ``labels``: rows like those of ``found`` with ``secret`` 1 or 0; null labels are left out. Of each class the ``train_rows`` / 2
    with the smallest hashes are used, so rare secrets are never crowded out, and both classes weigh the same. With labels of
    one class, or none, there is nothing to tell apart: the score is that class, or 0.
    """
    h = F.xxhash64(F.lit(seed), "value", "pos", "run", "doc_id")
    # The smallest of partial sorts, per class: a bounded training table.
    said = stored(labels.filter("secret IS NOT NULL").withColumn("h", h))
    ones, zeros = (said.filter(F.col("secret") == c).orderBy("h", "value", "pos", "run", "doc_id").limit(train_rows // 2).drop("h")
                   for c in (1.0, 0.0))
    train = stored(ones.union(zeros))
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.sum("secret").alias("s")).first()
    if not seen["n"] or seen["s"] in (0, seen["n"]):
        scored = found.withColumn("score", F.lit(1.0 if seen["n"] and seen["s"] else 0.0))
    else:
        sizes = {1.0: int(seen["s"]), 0.0: int(seen["n"] - seen["s"])}
        copies = {c: max(1, -(-LEAST_ROWS // k)) for c, k in sizes.items()}

        def by_class(values: dict) -> Column:
            return F.when(F.col("secret") == 1.0, F.lit(values[1.0])).otherwise(F.lit(values[0.0]))

        train = (train.withColumn("weight", by_class({c: seen["n"] / (2.0 * sizes[c] * copies[c]) for c in sizes}))
                 .withColumn("nth", F.explode(F.sequence(F.lit(1), by_class(copies)))))
        forest = RandomForestClassifier(featuresCol="features", labelCol="secret", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=seed)
        model = forest.fit(_vectors(train).select("features", "secret", "weight"))
        scored = (model.transform(_vectors(found)).withColumn("score", vector_to_array("probability")[1])
                  .drop("features", "rawPrediction", "probability", "prediction"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id", labels: DataFrame | None = None) -> DataFrame:
    """Findings of ``docs``: doc_id, pos, run, value, name, path, neighbours, features, score, is_secret.

    Null ids are ids like others, also of labels. ``labels``: doc_id, pos, secret of known findings, and run if a label is meant for one run of a word only (a null ``secret`` is left out; of contradicting labels the larger counts);
    if None, the findings of certain format label themselves (``labelled``). Columns of ``docs`` beyond those named play no part.
    """
    known = words_known(docs, text)
    found = stored(with_features(stored(candidates(docs, text, path, doc_id)), known, transitions(known)))
    if labels is None:
        return classify(found, labelled(found))
    keys = [c for c in ("doc_id", "pos", "run") if c in labels.columns]
    said = labels.groupBy(*[F.col(c).alias(f"l_{c}") for c in keys]).agg(F.max("secret").cast("double").alias("secret"))
    return classify(found, found.join(said, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in keys]).drop(*[f"l_{c}" for c in keys]))
