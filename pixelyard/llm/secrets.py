"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch, row_key
from pixelyard.llm.labelled import held_out

#: A run of at least 16 token characters with a digit, and base64 padding.
CANDIDATE = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{16,}+={0,2}"

# Words of names, paths and placeholders, and words that stand near secrets and near other ids.
DICTIONARY = ["about", "access", "account", "address", "admin", "alpha", "april", "article", "asset", "august", "backup", "beta", "build", "cache", "change", "client", "cloud", "code", "color", "commit", "common", "config", "content", "copy", "count", "data", "date", "debug", "default", "delete", "demo", "detail", "device", "document", "draft", "dummy", "email", "error", "event", "example", "export", "false", "file", "final", "font", "form", "group", "header", "home", "house", "http", "image", "import", "index", "input", "item", "july", "june", "label", "language", "layout", "level", "line", "link", "list", "local", "login", "main", "march", "master", "media", "menu", "message", "model", "module", "name", "news", "node", "number", "object", "order", "output", "package", "page", "part", "photo", "place", "player", "point", "post", "print", "product", "profile", "public", "query", "release", "report", "request", "result", "sample", "script", "search", "section", "server", "service", "setting", "size", "source", "state", "status", "style", "system", "table", "target", "temp", "test", "text", "theme", "time", "title", "true", "type", "update", "upload", "user", "value", "version", "video", "view", "week", "window", "word", "year"]
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential", "credentials", "private", "akia", "access_key", "login"]
OTHER_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "isbn", "version", "build", "revision", "example", "sample", "test", "dummy", "placeholder", "order", "invoice", "card", "phone", "id"]

FEATURES = ["length", "digits", "uppers", "lowers", "hex", "distinct", "class_changes", "vowel_changes", "longest_letters", "covered", "in_path", "has_extension", "assigned", "quoted", "secret_word", "other_word", "before_words"]
_WORD = r"[A-Za-z][A-Za-z0-9_\-]*"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, finding, before, after): every candidate of the whole texts, its place in code points
    from 0, and up to 80 code points on both sides.

    The text between the candidates and the candidates themselves, cut by the same pattern, give places
    and neighbours. Null and empty texts have none; rows that repeat give their findings again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(text.rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), *[k.alias(n) for k, n in zip(row_key(F.col(id_col), F.col(text_col)), ("row1", "row2"), strict=True)], F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))
    each = rows.select("doc_id", "row1", "row2", F.posexplode("found").alias("n", "finding"), "between")
    gap = F.get("between", F.col("n"))
    each = each.select("doc_id", "row1", "row2", "n", "finding", F.length(gap).alias("gap"), F.right(gap, F.lit(80)).alias("before"), F.left(F.get("between", F.col("n") + 1), F.lit(80)).alias("after"))
    # One document's findings stand together; the key is its row, so no source or text is hot.
    # Rows that repeat add up alike, so the sum is divided by their number.
    so_far = Window.partitionBy("row1", "row2").orderBy("n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    copies = F.count("*").over(Window.partitionBy("row1", "row2", "n"))
    at = F.floor(F.sum(F.col("gap") + F.length("finding")).over(so_far) / copies) - F.length("finding")
    return each.select("doc_id", at.cast("long").alias("at"), "finding", "before", "after")


def features(found: DataFrame) -> DataFrame:
    """``found`` with a double for each of ``FEATURES``."""
    c, n = F.col("finding"), F.length("finding")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    changes = lambda *pairs: F.regexp_count(c, F.lit("|".join(f"(?<=[{a}])(?=[{b}])" for a, b in pairs))) / n
    vowel, other = "aeiouAEIOU", "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"
    runs = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)
    left = F.substring_index(F.regexp_replace("before", r"[\x20\x09-\x0D]", " "), " ", -1)  # what is joined to the candidate
    words = F.regexp_extract_all(F.lower(F.concat(F.col("before"), F.lit(" "), F.substring("after", 1, 30))), F.lit(_WORD), F.lit(0))
    near = F.slice(words, F.greatest(F.lit(1), F.size(words) - 7), F.lit(8))
    hits = lambda known: F.size(F.array_intersect(near, F.array(*map(F.lit, known))))
    values: dict[str, Column] = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hex": share("[0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "class_changes": changes(("a-z", "A-Z0-9"), ("A-Z", "a-z0-9"), ("0-9", "A-Za-z")),
        "vowel_changes": changes((vowel, other), (other, vowel)),
        "longest_letters": F.coalesce(F.array_max(runs), F.lit(0)) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "in_path": (left.rlike(r"[/\\@.]") | c.rlike("^/|/.*/")).cast("int"),
        "has_extension": F.col("after").rlike(r"^[.@][A-Za-z0-9]{1,5}").cast("int"),
        "assigned": F.col("before").rlike(r"[=:]>?[\x20\x09]*[\"'`]?$").cast("int"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("int"),
        "secret_word": hits(SECRET_WORDS),
        "other_word": hits(OTHER_WORDS),
        "before_words": F.size(words),
    }
    return found.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()})


def label_findings(found: DataFrame) -> DataFrame:
    """Findings of which the label is sure, with ``label``: what a known issuer's format or an assignment to
    a secret's name marks is 1; plain numbers, words of letters with few digits, parts of paths and
    mail addresses, and what stands beside the names of checksums are 0. The rest stays unlabelled."""
    c = F.col("finding")
    issued = c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[bap]-|^sk_live_|^AIza[0-9A-Za-z_-]{35}$")
    named = F.col("before").rlike(r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\x20\x09]*[\"']?[=:]>?[\x20\x09]*[\"']?$")
    checksum = F.col("before").rlike(r"(?i)(commit|sha-?(1|256)|md5|checksum|uuid|isbn|order|invoice)[\x20\x09]*[:#=]?[\x20\x09]*$")
    plain = c.rlike("^[0-9+/_-]+$") | (F.regexp_count(c, F.lit("[0-9]")) * 8 < F.length(c)) | F.col("after").rlike("^@") | F.col("before").rlike(r"https?://[^\x20\x09-\x0D]*$")
    label = F.when(issued | named, 1).when(checksum | plain, 0)
    return found.withColumn("label", label).where(F.col("label").isNotNull())


def train(labelled: DataFrame, most: int = 20_000, trees: int = 40, depth: int = 6, seed: int = 11) -> PipelineModel | float:
    """A forest on at most ``most`` labelled findings (columns of ``findings`` and ``label``), those with the
    smallest hashes; with one class only, its rate (0.5 without rows)."""
    sample = labelled.orderBy(F.xxhash64("doc_id", "at", "finding"), "doc_id", "at").limit(most)
    sample = Scratch(labelled.sparkSession, "secrets").write("labelled", features(sample).select(*[f"f_{f}" for f in FEATURES], F.col("label").cast("double").alias("label")))
    low, high, rate = sample.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if low == high:
        return 0.5 if rate is None else float(rate)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=seed)
    assembler = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features")
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def scan(docs: DataFrame, model: PipelineModel | float, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, at, finding, score and is_secret (1 from ``threshold`` on) of every candidate."""
    seen = features(findings(docs, id_col, text_col))
    if isinstance(model, float):
        scored = seen.withColumn("score", F.lit(model))
    else:
        scored = model.transform(seen).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "at", "finding", "score", (F.col("score") >= threshold).cast("int").alias("is_secret"))


def scan_corpus(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """Learns from the sure findings of documents that aren't held out, and scans all documents."""
    labelled = label_findings(findings(docs.where(~held_out(F.col("doc_id")))))
    return scan(docs, train(labelled, most))
