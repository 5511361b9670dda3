"""Secret scan: candidate words, their features, and a random forest that removes false positives.

Everything is DataFrame expressions and MLlib on the JVM. Candidates are words with a digit (or a well-known prefix) that are
long enough to be a key; the forest sees their length, how character classes follow each other, how much of them a
dictionary knows, the path of the document and the words beside them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import written

MIN_CHARS = 12
FINDINGS = 6000
TREES, DEPTH, SEED = 24, 9, 11

# Prefixes of well-known keys, words beside secrets and beside look-alikes, words that names are made of.
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abpr]-|sk-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG\.)"
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api_?-?key|apikey|auth|bearer|credential|private|access|signing)"
OTHER_WORDS = r"(?i)(commit|sha-?\d*|md5|hash|checksum|digest|uuid|guid|version|build|example|placeholder|dummy|serial|order|invoice|isbn|revision|etag|phone|card|mail)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
DICTIONARY = (
    "access account address admin api app archive article asset author base blog build cache changeme class client code com common config "
    "content core count data date default demo dev display docs document download edu email error example file folder form format forum "
    "function group header help here home html http https image index info input item java javascript json key lib library line link list local localhost "
    "log login mail main manager map media member message model module name net new news node note number object order org output package page "
    "parameter password path people photo placeholder plugin post price private product profile project public python query report request response "
    "result root sample search secret section server service session site size source start static status store string summary system table "
    "tag target temp template test text theme time title token tools type update upload url user username util value version video view web "
    "wiki window word work world www year your").split()

KINDS = {
    "aws_key": r"^A[KS]IA[0-9A-Z]{16}$", "web_token": r"^eyJ[\w-]+\.", "prefixed_key": PREFIXES, "hex": r"^[0-9a-f]{16,}$|^[0-9A-F]{16,}$",
}
FEATURES = (
    "f_len", "f_digits", "f_upper", "f_lower", "f_other", "f_switches", "f_distinct", "f_letters_run", "f_vowels", "f_dictionary", "f_hex", "f_prefix",
    "f_dots", "f_at", "f_slash", "f_dash", "f_assigned", "f_secret_key", "f_secret_before", "f_other_before", "f_secret_after", "f_quoted", "f_test_path")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, word_pos, path, key, value, before, after, quoted): every word that may hold a secret.

    ``word_pos`` counts words from 0; ``key`` is what stands before = or : in the word, ``before`` the three words in front. Rows
    without any digit or known prefix are skipped before they are cut into words.
    """
    text = F.col(text_col).cast("string")
    narrowed = docs.where(text.rlike(r"[0-9]|AKIA|ASIA")).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("w"))
    found = narrowed.select("doc_id", "path", "w", F.explode(F.expr(f"""
        filter(transform(w, (x, i) -> struct(i AS i, x AS x)),
               c -> length(c.x) >= {MIN_CHARS} AND (c.x RLIKE '[0-9]' OR c.x RLIKE '^.?A[KS]IA[0-9A-Z]{{16}}'))""")).alias("c"))
    core = F.regexp_extract("word", r"""^["'`(\[{<]*(.*?)["'`)\]}>.,;:!?]*$""", 1)
    pieces = found.select(
        "doc_id", "path", F.col("c.i").cast("long").alias("word_pos"), F.col("c.x").alias("word"),
        F.lower(F.concat_ws(" ", F.slice("w", F.greatest(F.lit(1), F.col("c.i") - 2), F.least(F.lit(3), F.col("c.i"))))).alias("before"),
        F.coalesce(F.lower(F.expr("get(w, c.i + 1)")), F.lit("")).alias("after")).withColumn("core", core)
    assigned = r"^([A-Za-z_.\-]{2,40}?)\s*[=:]+[\"'`]*(?=[^/=:].{5})"
    key = F.regexp_extract("core", assigned, 1)
    return pieces.select(
        "doc_id", "word_pos", "path", key.alias("key"),
        F.when(key != "", F.regexp_replace("core", assigned, "")).otherwise(F.col("core")).alias("value"), "before", "after",
        F.col("word").rlike(r"""["'`]""").alias("quoted"))


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with the numbers that the forest sees; all finite, also for empty values."""
    v = F.col("value")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / size

    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = F.regexp_replace(F.translate(v, lower + upper + digits, "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", "-")
    known = F.array(*[F.lit(w) for w in DICTIONARY])
    parts = F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), 0)
    covered = F.aggregate(F.filter(parts, lambda p: F.array_contains(known, p)), F.lit(0), lambda n, p: n + F.length(p))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), 0), lambda p: F.length(p))), F.lit(0))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    return found.withColumns({
        "f_len": F.least(F.length(v), F.lit(256)).cast("double"), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"),
        "f_other": share("[^0-9A-Za-z]"), "f_switches": F.length(F.regexp_replace(classes, r"(.)\1*", "x")) / size,
        "f_distinct": F.size(F.array_distinct(F.split(F.substring(v, 1, 64), ""))) / F.least(size, F.lit(64.0)),
        "f_letters_run": longest / size, "f_vowels": share("[aeiouAEIOU]"), "f_dictionary": covered / size,
        "f_hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "f_prefix": flag(v.rlike(PREFIXES)), "f_dots": share(r"[.]"), "f_at": flag(v.contains("@")),
        "f_slash": flag(v.contains("/")), "f_dash": share("-"), "f_assigned": flag((F.col("key") != "") | F.col("before").rlike("[=:]$")),
        "f_secret_key": flag(F.col("key").rlike(SECRET_WORDS)), "f_secret_before": flag(F.col("before").rlike(SECRET_WORDS)),
        "f_other_before": flag(F.concat_ws(" ", "before", "key").rlike(OTHER_WORDS)), "f_secret_after": flag(F.col("after").rlike(SECRET_WORDS)),
        "f_quoted": flag(F.col("quoted")), "f_test_path": flag(F.col("path").rlike(TEST_PATH)),
    })


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source, label): short texts around one candidate each, as secrets (1) and look-alikes (0) are written.

    The tables have no labelled findings, so these forms are the labelled data; they are drawn by hashes of row numbers.
    """
    def pick(values: list[str], salt: int) -> str:
        return f"element_at(array({', '.join(repr(x) for x in values)}), 1 + cast(pmod(xxhash64(id, {seed + salt}), {len(values)}) AS int))"

    def number(low: int, high: int, salt: int) -> str:
        return f"cast({low} + pmod(xxhash64(id, {seed + salt}), {high - low + 1}) AS string)"

    def hexes(length: str, salt: int) -> str:
        return f"substr(concat(sha2(concat(id, '-{seed + salt}'), 256), sha2(concat(id, '+{seed + salt}'), 256)), 1, {length})"

    def mixed(length: str, salt: int) -> str:
        return f"substr(translate(base64(unhex({hexes('120', salt)})), '+/=\\r\\n', 'xYz'), 1, {length})"

    word = ["ther", "onsh", "edti", "ingre", "haan", "lyou", "esse", "de", "la", "und", "queen", "blewh"]
    name = ["user", "profile", "summary", "report", "index", "page", "image", "module", "thering", "onshand"]
    secret = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "auth_token", "access_key", "private_key"]
    other = ["commit", "sha256", "md5", "checksum", "digest", "revision", "etag", "hash", "build"]
    upper = f"translate({mixed('16', 3)}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    size = "cast(16 + pmod(xxhash64(id, 91), 40) AS int)"
    assign = pick([" = ", "=", ": ", ":", "="], 5)
    quote = pick(["\"", "", ""], 6)
    secrets = [
        f"concat({pick(secret, 1)}, {assign}, {quote}, {hexes(size, 2)}, {quote})",
        f"concat({pick(secret, 1)}, ' = ', '\"', {hexes('40', 2)}, '\"')", f"concat('password=', {hexes('18', 2)})",
        f"concat({pick(secret, 1)}, {assign}, {quote}, {mixed(size, 2)}, '7', {quote})", f"concat({pick(['AKIA', 'ASIA'], 1)}, {upper})",
        f"concat({pick(['AKIA', 'AKIA', 'key AKIA'], 1)}, {upper})", f"concat({pick(['ghp_', 'sk_live_', 'xoxb-', 'AIza', 'glpat-', 'npm_'], 1)}, {mixed('30', 2)}, '4')",
        f"concat('Bearer eyJ', {mixed('40', 2)}, '.', {mixed('60', 4)}, '1')"]
    others = [
        f"concat({pick(name, 1)}, '.', {number(1, 99, 2)}, '@mail', {number(0, 9, 3)}, '.example.', {pick(['com', 'org', 'net'], 4)})",
        f"concat({number(10, 250, 1)}, '.', {number(10, 250, 2)}, '.', {number(10, 250, 3)}, '.', {number(100, 250, 4)})",
        f"concat({number(10 ** 12, 10 ** 16 - 1, 1)})", f"concat('+', {number(1, 99, 1)}, '-', {number(100, 999, 2)}, '-', {number(1000, 9999, 3)}, '-', {number(10, 99, 4)})",
        f"concat({pick(other, 1)}, {pick([' ', ': ', '=', ' = '], 5)}, {hexes('40', 2)})", f"concat({pick(other, 1)}, {pick([' ', ': ', '='], 5)}, {hexes('64', 2)})",
        f"concat({pick(['uuid ', 'id ', '', 'guid='], 1)}, {hexes('8', 2)}, '-', {hexes('4', 3)}, '-', {hexes('4', 4)}, '-', {hexes('4', 5)}, '-', {hexes('12', 6)})",
        f"concat('https://www.', {pick(name, 1)}, '.com/', {pick(name, 2)}, '/', {number(1, 99999, 3)}, '.html')",
        f"concat({pick(name, 1)}, '/', {pick(name, 2)}, {number(1, 99, 3)}, '/', {pick(name, 4)}, '.py')",
        f"concat({pick(name, 1)}, '_', {pick(name, 2)}, '_', {number(1990, 2030, 3)}, '_', {pick(name, 4)})",
        f"concat({number(1990, 2030, 1)}, '-0', {number(1, 9, 2)}, '-1', {number(0, 9, 3)}, 'T1', {number(0, 9, 4)}, ':2', {number(0, 9, 5)}, ':00')",
        f"concat({pick(secret, 1)}, {pick(['=', ' = ', ': '], 5)}, {pick(['your_password_here1', 'changeme123456', 'example-token-1', 'placeholder12345', 'test_secret_key1'], 3)})",
        f"concat({pick(['rev', 'ABC', 'SKU', 'No'], 1)}, '-', {number(1000, 9999, 2)}, '-', {number(1000, 9999, 3)}, '-', {number(10, 99, 4)})"]
    forms = [(s, 1) for s in secrets] + [(o, 0) for o in others]
    choice = "CASE pmod(id, {}) {} END".format(len(forms), " ".join(f"WHEN {i} THEN {s}" for i, (s, _) in enumerate(forms)))
    label = f"CAST(pmod(id, {len(forms)}) < {len(secrets)} AS int)"
    return spark.range(0, n, 1, 4).selectExpr(
        "id AS doc_id", f"concat({pick(word, 21)}, ' ', {pick(word, 22)}, ' ', {choice}, ' ', {pick(word, 23)}, '.') AS text",
        f"{pick(['src/main', 'web', 'notes', 'tests/data', 'docs', 'blog'], 24)} AS source", f"{label} AS label")


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found))


def fit(spark: SparkSession, n: int = FINDINGS) -> RandomForestClassificationModel:
    """The forest, trained on at most ``n`` labelled findings."""
    labelled = labelled_findings(spark, n)
    found = candidates(labelled).join(F.broadcast(labelled.select("doc_id", "label")), "doc_id")  # at most ``n`` rows
    rows = written(with_features(found).select("doc_id", "word_pos", "label", *FEATURES), "findings").repartition(2, "doc_id").sortWithinPartitions("doc_id", "word_pos")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features").fit(vectors)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source") -> DataFrame:
    """(doc_id, word_pos, kind, value, score, is_secret): one row for each candidate; false positives have ``is_secret`` false.

    Null and empty texts have no candidates; a null path is no test path; repeated rows each give their findings. Extra
    columns are not read. Nothing is shuffled: candidates are scored where their text is read.
    """
    model = model or fit(docs.sparkSession)
    scored = model.transform(_vectors(candidates(docs, id_col, text_col, path_col)))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(
        "doc_id", "word_pos", F.coalesce(kind, F.when(F.col("key") != "", "assigned").otherwise("other")).alias("kind"), "value", score.alias("score"),
        (score >= 0.5).alias("is_secret"))
