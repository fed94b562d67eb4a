"""Secret candidates and a random forest that removes false findings; DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import stored

#: A candidate: a run of at least so many of these characters with a digit in it, of a known format, or named as a secret.
LEAST_LENGTH = 12
_RUN = rf"[A-Za-z0-9+/_=.@:-]{{{LEAST_LENGTH},}}"
#: Bound of the learning sample: findings per label.
SAMPLE_ROWS = 10_000
TREES, DEPTH = 24, 6

# Formats of known secrets (one whole candidate), words and formats that name what follows.
FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$|^xox[abp]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$"
NAMES = r"(?i)(password|passwd|secret|token|api_?key|private_?key|credential)"
#: The same formats wherever they stand in a run.
_KNOWN = "(?<![A-Za-z0-9])(?:" + FORMATS.replace("^", "").replace("$", "") + ")(?![A-Za-z0-9])"
#: The name of a value, at the end of the text before it: name=", "name":", <name>.
_NAME_BEFORE = r"([A-Za-z0-9_.-]+)[^A-Za-z0-9,;&]*[=:>][^A-Za-z0-9,;&]*$"
#: Names at the head of a run.
_NAMES_INSIDE = r"^[^A-Za-z]*((?:[A-Za-z_]+[=:]+)+)"
#: Formats that are known not to be secrets.
HARMLESS = r"^[0-9.:/+-]+$|^[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+$|^(https?:)?//"

# Parts of a path that speak of settings, and of texts that are not in use.
SETTINGS = r"(?i)(^|[/._-])(env|conf|config|settings|credentials?|secrets?|deploy)([/._-]|$)"
EXAMPLES = r"(?i)(^|[/._-])(tests?|examples?|samples?|fixtures?|docs?|mocks?)([/._-]|$)"

#: What the forest sees. Names of values give labels, so no name is among these.
FEATURES = ["length", "digits", "uppers", "hex", "turns", "transitions", "distinct", "dictionary", "before_known", "after_known", "path_root", "path_depth", "path_settings", "path_examples"]


def _strip(word: Column) -> Column:
    return F.regexp_replace(word, r"[^A-Za-z0-9]+$|^[^A-Za-z0-9]+", "")


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id, word_no, run_no, candidate, before, after, named, assigned, other, path``: every candidate with its neighbouring words.

    A word is what stands between blanks; each of its runs gives a candidate (``run_no`` counts
    them from 0), ``name=value`` is split at the sign, and what has a known format inside a longer
    run is a candidate too. ``assigned`` says that a name of a secret is given to the value, before
    it in the word or by a sign at the end of the word before; ``named`` also that one of the two
    words before has such a name; ``other`` that the value is given another name. ``before`` is the
    nearest of the three words before that is neither a sign nor the name of a value, so that
    it says nothing of the name. Candidates without a digit are those of known formats and named ones.
    """
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    has = F.col("text").rlike(_RUN)

    def names(i: Column) -> Column:
        return F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1), F.col("words")[i])

    def worth(i: Column) -> Column:
        word = F.col("words")[i]
        return word.rlike(_RUN) & (word.rlike("[0-9]") | word.rlike(_KNOWN) | names(i).rlike(NAMES))

    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), worth)
    path = F.concat_ws("/", *[F.col(c).cast("string") for c in path_cols]) if path_cols else F.lit("")
    near = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text")).where(has).withColumn("words", words).drop("text")
    each = near.withColumn("word_no", F.explode(spots))

    def at(step: int) -> Column:
        k = F.col("word_no") + step
        return F.when((k >= 0) & (k < F.size("words")), F.col("words")[F.greatest(F.least(k, F.size("words") - 1), F.lit(0))])

    all_runs = F.regexp_extract_all(at(0), F.lit(f"({_RUN})"), F.lit(1))
    # what stands before each run: the run before it and the text between
    zipped = F.arrays_zip(all_runs.alias("run"), F.concat(F.array(F.lit("")), all_runs).alias("earlier"), F.split(at(0), _RUN).alias("between"))
    placed = each.select("doc_id", "word_no", "path", at(-3).alias("_three"), at(-2).alias("_two"), at(-1).alias("_one"), at(1).alias("_next"), F.posexplode(zipped).alias("run_no", "_z"))
    run = F.col("_z.run")
    own = F.concat_ws(" ", F.regexp_extract(F.concat("_z.earlier", "_z.between"), _NAME_BEFORE, 1), F.regexp_extract(run, _NAMES_INSIDE, 1))
    candidates = F.array_distinct(F.concat(F.array(_strip(F.regexp_replace(run, r"^[A-Za-z_]+[=:]+", ""))), F.regexp_extract_all(run, F.lit(_KNOWN), F.lit(0))))
    named = F.concat_ws(" ", own, "_two", "_one").rlike(NAMES)
    signed = F.coalesce(F.col("_one").rlike("[=:]$"), F.lit(False)) & (F.col("run_no") == 0)
    other = ~named & (signed | (F.trim(own) != ""))

    def unless_name(word: str, later: str | None) -> Column:
        names_value = F.col(word).rlike("[=:]$") | F.col(word).rlike(NAMES)
        if later is not None:
            names_value = names_value | F.col(later).rlike("^[=:]+$")
        return F.when(F.col(word).rlike("[A-Za-z0-9]") & ~names_value, F.col(word))

    before = F.coalesce(unless_name("_one", None), unless_name("_two", "_one"), unless_name("_three", "_two"), F.lit(""))
    found = placed.where(run.isNotNull()).select(
        "doc_id", "word_no", "run_no", F.explode(candidates).alias("candidate"), F.lower(_strip(before)).alias("before"),
        F.lower(_strip(F.coalesce("_next", F.lit("")))).alias("after"), named.alias("named"), (own.rlike(NAMES) | (signed & named)).alias("assigned"), other.alias("other"), "path",
    )
    return found.where((F.length("candidate") >= LEAST_LENGTH) & (F.col("candidate").rlike("[0-9]") | F.col("candidate").rlike(FORMATS) | F.col("named")))


def known_labels(found: DataFrame) -> DataFrame:
    """With ``label``: 1 for a known format or a named value of mixed characters, 0 for a harmless format, an unnamed plain one or the value of another name, null if not known.

    A value without a digit counts as named only if the name is given to it; a word that follows a
    name is not known. Labels come from formats and names, which the forest does not see: it learns
    how such values look, and judges those that no rule knows.
    """
    mixed = F.col("candidate").rlike("[A-Za-z]")
    value = F.col("named") & (F.col("assigned") | F.col("candidate").rlike("[0-9]"))
    label = F.when(F.col("candidate").rlike(HARMLESS), 0.0).when(F.col("candidate").rlike(FORMATS) | (value & mixed), 1.0).when(~mixed | F.col("other"), 0.0)
    return found.withColumn("label", label)


def transition_costs(dictionary: DataFrame) -> DataFrame:
    """``pair, cost`` for all 784 pairs of a letter, a digit (as 0) or another character (as a blank).

    ``cost`` is minus the logarithm, in whole millionths, of the chance that the second follows
    the first in the dictionary's words, every pair counted once more than seen.
    """
    marks = F.split(F.lit("abcdefghijklmnopqrstuvwxyz0 "), "")
    pairs = F.explode(F.regexp_extract_all(F.concat(F.lit(" "), "word", F.lit(" ")), F.lit("(?=(..))"), F.lit(1)))
    seen = dictionary.select(pairs.alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    every = dictionary.sparkSession.range(1).select(F.explode(marks).alias("a")).select("a", F.explode(marks).alias("b")).select("a", F.concat("a", "b").alias("pair"))
    counted = every.join(seen, "pair", "left").select("a", "pair", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    totals = counted.groupBy("a").agg(F.sum("n").alias("total"))
    return counted.join(totals, "a").select("pair", F.round(-F.log(F.col("n") / F.col("total")) * 1_000_000).cast("long").alias("cost"))


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """FEATURES of every candidate. ``dictionary``: word (distinct, lower case).

    Length; shares of digits, capitals and hexadecimal characters; changes between letters, digits
    and others by length; mean cost of its character transitions after the dictionary's words; share
    of distinct characters; share of its letters that stand in dictionary words; the neighbours'
    presence in the dictionary; of the path its first part (hashed), its depth and whether it speaks
    of settings or of examples.
    """
    c, size = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    turns = r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"
    # each distinct word that is looked up, once
    key = ["doc_id", "word_no", "run_no", "candidate"]
    runs = found.select(*key).distinct().select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{2,})"), F.lit(1)))).alias("word"))
    covered = runs.join(dictionary, "word").groupBy(*key).agg(F.sum(F.length("word")).alias("letters"))
    # letters, digits and others; sums of whole numbers are the same in any order
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), "[0-9]", "0")
    steps = found.select(*key).distinct().select(*key, F.explode(F.regexp_extract_all(plain, F.lit("(?=(..))"), F.lit(1))).alias("pair"))
    costs = steps.join(F.broadcast(transition_costs(dictionary)), "pair").groupBy(*key).agg((F.sum("cost") / F.count("*") / 1_000_000).alias("transitions"))
    known = dictionary.select("word", F.lit(1.0).alias("hit"))
    joined = found.join(covered, key, "left").join(costs, key, "left")
    joined = joined.join(known.withColumnsRenamed({"word": "before", "hit": "before_hit"}), "before", "left").join(known.withColumnsRenamed({"word": "after", "hit": "after_hit"}), "after", "left")
    parts = F.filter(F.split("path", "/"), lambda part: part != "")
    return joined.select(
        *found.columns, size.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[0-9a-fA-F]").alias("hex"), share(turns).alias("turns"),
        F.coalesce("transitions", F.lit(0.0)).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / size).alias("distinct"), F.least(F.lit(1.0), F.coalesce(F.col("letters"), F.lit(0)) / size).alias("dictionary"),
        F.coalesce("before_hit", F.lit(0.0)).alias("before_known"), F.coalesce("after_hit", F.lit(0.0)).alias("after_known"),
        F.coalesce(F.pmod(F.xxhash64(F.get(parts, F.lit(0))), F.lit(16)), F.lit(16)).cast("double").alias("path_root"), F.size(parts).cast("double").alias("path_depth"),
        F.col("path").rlike(SETTINGS).cast("double").alias("path_settings"), F.col("path").rlike(EXAMPLES).cast("double").alias("path_examples"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    doubles = rows.withColumns({f"_f_{c}": F.col(c).cast("double") for c in FEATURES})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in FEATURES], outputCol="_features").transform(doubles).drop(*[f"_f_{c}" for c in FEATURES])


def fit_forest(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> RandomForestClassificationModel | None:
    """A forest of the rows with a label; at most ``rows`` of each label, the same at every run. None if a label is missing."""
    order = [F.xxhash64("doc_id", "word_no"), F.col("doc_id"), F.col("word_no"), F.col("run_no"), F.col("candidate")]
    parts = [labelled.where(F.col("label") == k).orderBy(*order).limit(rows) for k in (0.0, 1.0)]
    sample = stored(parts[0].unionByName(parts[1]).select("doc_id", "word_no", "run_no", "candidate", "label", *FEATURES).coalesce(1).sortWithinPartitions(*order))
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(labelCol="label", featuresCol="_features", numTrees=TREES, maxDepth=DEPTH, seed=5).fit(_vectors(sample))


def scan_secrets(docs: DataFrame, dictionary: DataFrame, labels=known_labels, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id, word_no, run_no, candidate_sha256, length, named, probability, secret`` of every candidate of every whole text.

    A random forest, fitted on the candidates that ``labels`` gives a label and ``learn`` admits,
    gives each candidate's probability of being a secret; those below one half are false findings.
    The secret itself is not returned, only its digest and place (``word_no`` counts the words of
    the text, ``run_no`` the runs of the word, from 0). Null and empty texts have no candidate; repeated rows that share an id give
    the same candidates once; a null id is kept; other columns are ignored. Whole texts are searched,
    however long; equal candidates at different places are rows of their own (ties in the learning
    sample go by hash, id and place); an empty table gives no row. With no labelled secret, or no
    harmless one, probabilities are null and every candidate stays a finding.
    """
    found = stored(find_candidates(docs, id_col, text_col, path_cols).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).distinct())
    ready = stored(labels(features(found, dictionary)))
    admitted = ready.where("label IS NOT NULL")
    model = fit_forest(admitted if learn is None else admitted.where(learn))
    scored = ready.withColumn("probability", F.lit(None).cast("double")) if model is None else model.transform(_vectors(ready)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "word_no", "run_no", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "named",
        F.round("probability", 9).alias("probability"), F.coalesce(F.col("probability") >= 0.5, F.lit(True)).alias("secret"),
    )


def held_out_quality(ready: DataFrame, learn: Column) -> DataFrame:
    """One row ``positives, found, findings, precision, recall``: a forest fitted where ``learn`` holds, measured on the other rows with a label.

    ``ready`` has FEATURES and ``label``. Shares are null where there is nothing to divide by.
    """
    labelled = ready.where("label IS NOT NULL")
    model = fit_forest(labelled.where(learn))
    if model is None:
        raise ValueError("both labels are needed to fit a forest")
    is_learnt = F.coalesce(learn, F.lit(False))
    said = model.transform(_vectors(labelled.where(~is_learnt))).select("label", (vector_to_array("probability")[1] >= 0.5).alias("said"))
    counts = said.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if((F.col("label") == 1) & F.col("said")).alias("found"), F.count_if("said").alias("findings"))
    return counts.select("*", F.try_divide("found", "findings").alias("precision"), F.try_divide("found", "positives").alias("recall"))


def dictionary_of(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct lower-case words of letters of a table of clean texts."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("([a-z]{2,})"), F.lit(1))
    return texts.where(F.col(text_col).isNotNull()).select(F.explode(words).alias("word")).distinct()
