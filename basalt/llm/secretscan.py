"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a word of ``MIN_CHARS`` characters or more with a digit in it, a word in a published key format, or,
at any length, the value that a secret's name is given, in one word (quoted, dotted and numbered names too) or in
the words before. Keys in a published format are secrets whatever the forest says. A candidate's features are its length,
how often its characters change class and how many differ, how much of it is words of the dictionary (all words
that make up one in ``SHARE`` of the corpus's words or more, so ``SHARE`` at most), whether its path is one of tests and
samples or of settings, and the words next to it. The forest is trained on labelled findings: those given, or, without
any, those that a published key format or an assignment to a secret's name marks as secrets, and those that are
plainly an address, an e-mail or a number. Scanning is then one pass of SQL functions: the trees are CASE
expressions over a row's candidates, and nothing is shuffled.

Null and empty texts have no candidates. Null paths count as empty. Texts of any length are read whole, each repeated
candidate counts. Without labelled findings of both kinds (as in an empty table) the labels themselves
decide. Repeated rows each give their rows. Other columns pass through ``redacted``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_CHARS = 12
#: Labelled findings of each kind that the forest is fitted on, at most; a word of the dictionary is one in so many words.
LABELLED, SHARE = 20_000, 50_000
TREES, DEPTH, SEED = 20, 5, 7
FEATURES = ("length", "runs", "different", "digits", "upper", "covered", "path_sample", "path_config", "named", "sample")
#: A secret's name as a whole, and a word's part up to its value: a plain name, or one that holds a secret's name.
_SECRET = "(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_.-]?key|access[_.-]?key|private[_.-]?key|auth|authorization|credential|bearer)s?(?:[_.-]?(?:key|id|value|hash|token))*(?![A-Za-z])"
_OPEN, _KEY = "[^A-Za-z0-9 ]*", "[A-Za-z0-9_.$-]*"
_GIVEN = f"""^{_OPEN}(?:(?i:{_KEY}{_SECRET})[A-Za-z0-9_.-]{{0,20}}[\"'`\\])]{{0,3}}(?::=|=>|[=:])(?=[^A-Za-z0-9]{{0,3}}[A-Za-z0-9]))"""
_NAME = "^[A-Za-z_-]{2,30}[=:]"
_NAMED_BEFORE = f"""(?i)(?:^|[^a-z]){_KEY}{_SECRET}[A-Za-z0-9_.-]{{0,20}}[\"'`\\])]{{0,3}}"""
_AFTER = "(?::=|=>|[=:])"
_FORMATS = "(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs)_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,})(?![0-9A-Za-z])"
_FORMAT = "^(AKIA|ASIA)[0-9A-Z]{16}$|^(ghp|gho|ghs)_[0-9A-Za-z]{36}$|^xox[abp]-[0-9A-Za-z-]{10,}$"


def _q(pattern: str) -> str:
    """As a string in SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_WORDS = r"split(coalesce(text, ''), '[\\s]+')"
# Lower-case names in the words nearby; what goes on in letters (author, passenger, secretary) is another word.
_NAMES = "(password|passwd|passphrase|token|secret|api.?key|access.?key|private.?key|credential|authorization)s?(?![a-z])|(?<![a-z])(pass|pwd|auth|bearer)(?![a-z])"
_PATH_SAMPLE = "(?i)(^|[^a-z])(tests?|spec|examples?|samples?|fixtures?|mocks?|docs?)([^a-z]|$)"
_PATH_CONFIG = r"(?i)(^|[/.])(env|config|settings|secrets?|credentials?)([/.]|$)|[.](ya?ml|json|toml|ini|cfg|conf|properties|pem|key)$"
_SAMPLES = "example|sample|dummy|placeholder|changeme|test"


def dictionary(docs: DataFrame, text: str = "text") -> list[str]:
    """The words of lower-case letters that make up one in ``SHARE`` of all such words in all texts, at least."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{3,15})\b"), F.lit(1))).alias("w"))
    counts = written(words.groupBy("w").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return sorted(r.w for r in counts.filter(F.col("count") * SHARE >= total).collect())  # SHARE at most


def candidates(docs: DataFrame, known: list[str]) -> DataFrame:
    """``docs`` (with ``text`` and ``path``) and ``found``: an array of candidates, with features and label."""
    # One expression, whose words are bound once: what refers to it may be pushed down and computed again.
    # A name in the same word is cut off its value; one in the words before ends in, or is followed by, = or :.
    here = f"((contains(w[i], '=') OR contains(w[i], ':')) AND w[i] RLIKE {_q(_GIVEN)})"
    ends = f"(get(w, i - 1) RLIKE '[=:]$' AND get(w, i - 1) RLIKE {_q(_NAMED_BEFORE + _AFTER + '$')})"
    apart = f"(get(w, i - 1) IN ('=', ':', ':=', '=>') AND get(w, i - 2) RLIKE {_q(_NAMED_BEFORE + '$')})"
    bearer = "(lower(get(w, i - 1)) = 'bearer')"
    before = f"(coalesce({ends}, false) OR coalesce({apart}, false) OR coalesce({bearer}, false)) AND w[i] RLIKE '[A-Za-z0-9]'"
    form = f"(length(w[i]) >= 14 AND w[i] RLIKE {_q(_FORMATS)})"
    value = f"regexp_replace(CASE WHEN {form} THEN regexp_extract(w[i], {_q(_FORMATS)}, 0) WHEN {here} THEN regexp_replace(w[i], {_q(_GIVEN)}, '') ELSE regexp_replace(w[i], '{_NAME}', '') END, '^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$', '')"
    key = f"CASE WHEN {here} THEN regexp_extract(w[i], {_q(_GIVEN)}, 0) ELSE regexp_extract(w[i], '{_NAME}', 0) END"
    plain = f"length(w[i]) >= {MIN_CHARS} AND w[i] RLIKE '[0-9]'"

    def words(chosen: str, value: str, given: str, key: str) -> str:
        return rf"""element_at(transform(array({_WORDS}), w ->
                transform(filter(sequence(0, size(w) - 1), i -> {chosen}), i -> named_struct('at', i, 'value', {value}, 'given', {given},
                'near', lower(concat_ws(' ', get(w, i - 2), get(w, i - 1), {key}, get(w, i + 1)))))), 1)"""

    # A text with neither a secret's name nor a format's first letters needs only the plain choice.
    may = f"text RLIKE {_q('(?i)' + _SECRET)} OR contains(text, 'AKIA') OR contains(text, 'ASIA') OR contains(text, 'gh') AND text RLIKE 'gh[pos]_' OR contains(text, 'xox')"
    full = words(f"({plain}) OR {form} OR {here} OR ({before})", value, f"CASE WHEN {here} THEN 2 WHEN {before} THEN 1 ELSE 0 END", key)
    short = words(plain, f"regexp_replace(regexp_replace(w[i], '{_NAME}', ''), '^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$', '')", "0", f"regexp_extract(w[i], '{_NAME}', 0)")
    near = docs.withColumn("found", F.expr(f"CASE WHEN {may} THEN {full} ELSE {short} END"))
    listed = ", ".join(f"'{w}'" for w in known) or "''"
    return near.withColumn(
        "found",
        F.expr(
            rf"""transform(found, c -> named_struct('at', c.at, 'value', c.value, 'given', c.given,
                'length', double(length(c.value)),
                'runs', double(length(regexp_replace(c.value, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+', 'x'))),
                'different', double(size(array_distinct(split(c.value, '')))),
                'digits', length(regexp_replace(c.value, '[^0-9]', '')) / greatest(length(c.value), 1),
                'upper', length(regexp_replace(c.value, '[^A-Z]', '')) / greatest(length(c.value), 1),
                'covered', aggregate(filter(regexp_extract_all(lower(c.value), '[a-z]{{3,}}', 0), r -> r IN ({listed})), 0, (n, r) -> n + length(r)) / greatest(length(c.value), 1),
                'path_sample', double(int(coalesce(path, '') RLIKE {_q(_PATH_SAMPLE)})), 'path_config', double(int(coalesce(path, '') RLIKE {_q(_PATH_CONFIG)})),
                'named', double(int(c.given > 0 OR c.near RLIKE '{_NAMES}')),
                'sample', double(int(c.near RLIKE '{_SAMPLES}')),
                'label', CASE WHEN c.value RLIKE '^(AKIA|ASIA)[0-9A-Z]{{16}}$' THEN 1
                              WHEN c.value RLIKE '^(ghp|gho|ghs)_[0-9A-Za-z]{{36}}$|^xox[abp]-[0-9A-Za-z-]{{10,}}$' THEN 1
                              WHEN c.near RLIKE '({_NAMES})[^ ]{{0,10}} ?[=:]' AND c.value RLIKE '^[0-9A-Za-z_+/=-]{{16,}}$' THEN 1
                              WHEN c.value RLIKE '^[0-9.,:/-]+$' OR c.value RLIKE '@[A-Za-z0-9-]+[.]' OR c.value RLIKE '^[a-z]+://' THEN 0
                              WHEN length(c.value) >= 6 AND (c.given = 2 OR c.given = 1 AND c.value RLIKE '[0-9]') THEN 1 END))"""
        ),
    )


def train(found: DataFrame) -> RandomForestClassificationModel | None:
    """A forest on a sample of the labelled candidates, bounded by ``LABELLED``; None without both labels. Where
    ``found`` has the columns ``of_value`` and ``of_secret``, they label the candidates with that value."""
    each = found.selectExpr("*", "inline_outer(found)")
    if "of_value" in found.columns:
        each = each.filter(F.col("value") == F.col("of_value")).withColumn("label", F.col("of_secret").cast("int"))
    each = each.select("value", "at", "label", *FEATURES).filter(F.col("label").isNotNull())
    order = F.xxhash64("value", "at")
    picked = [each.filter(F.col("label") == k).orderBy(order, "value").limit(LABELLED) for k in (0, 1)]
    rows = written(picked[0].unionByName(picked[1]))
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(vectors.select("features", F.col("label").cast("double")))


def expression(model: RandomForestClassificationModel | None, of: str = "c") -> str:
    """The forest's probability of a secret as SQL over a candidate ``of``."""
    if model is None:
        return f"coalesce(double({of}.label), 0D)"

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            stats = list(n.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-12)!r}D"
        split = n.split()
        return f"CASE WHEN {of}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    trees = [node(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else node(t._call_java("rootNode")) for t in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}D"


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``found``: an array of ``at`` (number of the word), ``value``, ``label``, ``score`` and
    ``secret`` for each candidate in the text. ``labelled`` has findings to learn from: ``text, path, value,
    secret`` (whether the value is one). Without it, findings in ``docs`` are labelled by their form."""
    known = dictionary(docs)
    rows = candidates(docs.select(F.struct("*").alias("row"), F.col(path).cast("string").alias("path"), "text"), known)
    learned_from = rows
    if labelled is not None:
        learned_from = candidates(labelled.select("text", "path", F.col("value").alias("of_value"), F.col("secret").alias("of_secret")), known)
    scored = f"CASE WHEN c.value RLIKE '{_FORMAT}' THEN 1D ELSE {expression(train(learned_from))} END"
    kept = F.expr(f"transform(found, c -> named_struct('at', c.at, 'value', c.value, 'given', c.given, 'label', c.label, 'score', {scored}))")
    marked = F.expr("transform(found, c -> named_struct('at', c.at, 'value', c.value, 'label', c.label, 'score', c.score, 'secret', c.score >= 0.5))")
    out = rows.withColumn("found", kept).withColumn("found", marked)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "found"), "found")


def redacted(docs: DataFrame, path: str = "source", mark: str = "[REDACTED]", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; columns and rows stay."""
    # Long values and those of several classes go wherever they stand; a short or plain word only where its name gives it.
    wide = f"(length(c.value) >= {MIN_CHARS} AND c.value RLIKE '[0-9]' OR c.value RLIKE '{_FORMAT}')"
    secrets = f"array_sort(array_distinct(transform(filter(found, c -> c.secret AND c.value != ''), c -> named_struct('value', c.value, 'wide', {wide}))), (a, b) -> length(b.value) - length(a.value))"
    behind = f"((?i:(?:^|[^a-z]){_KEY}{_SECRET})[A-Za-z0-9_.-]{{0,20}}[\"'`\\])]{{0,3}}\\s*(?:{_AFTER}|(?<=(?i:bearer))\\s)[^A-Za-z0-9]{{0,8}})"
    one = f"regexp_replace(t, concat({_q(behind)}, '\\\\Q', v.value, '\\\\E', '(?![A-Za-z0-9])'), '$1{mark}')"
    clean = F.expr(f"aggregate({secrets}, text, (t, v) -> CASE WHEN v.wide THEN replace(t, v.value, '{mark}') ELSE {one} END)")
    whole = docs.select(F.struct("*").alias("row"), "text", F.col(path).cast("string").alias("path"))
    done = scan(whole, "path", labelled).withColumn("text", clean)
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
