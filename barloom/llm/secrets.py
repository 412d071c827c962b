"""Secret scanning with a random forest that removes false positives.

A pattern names candidates: what is assigned to a credential's name or stands in the user
part of a URL, of any length and signs, and unbroken runs of letters, digits and a few
signs. Each is
described by its length, its character classes and the transitions between them, how
much of it dictionary words cover, the path of its document, and the words and signs
next to it. A random forest trained on labelled findings then says which candidates are
secrets. The dictionary is the words found in most documents, counted over all of them.

Everything is DataFrame expressions: candidates stay in an array of their row, and the
trained trees become nested conditions, so scanning and redacting is one pass with no
shuffle, join or Python. At most ``TRAIN_ROWS`` labelled findings train the forest.

Nulls and the like: a null or empty text has no candidates and stays as it is; a null
path counts as empty. Labelled findings without a label teach nothing; with one kind of
label only, a fixed rule judges (``RULE``), and with none nothing is a secret. Repeated rows and ties are judged alike.
Added columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.sampling import first_by_hash
from barloom.scratch import stored

DICTIONARY_WORDS = 300
TRAIN_ROWS = 40_000
N_TREES = 20
MAX_DEPTH = 6
CONTEXT_CHARS = 64
MASK = "<secret>"

FINDING = "struct<value:string,before:string,after:string>"

#: Fixed words of credentials, of placeholders, and of paths.
CREDENTIAL = r"(?i)token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer"
PLACEHOLDER = r"(?i)example|sample|dummy|fake|placeholder|changeme|your|xxxx|test"
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|specs?|mocks?|examples?|docs?|fixtures?|samples?)([/_.\-]|$)"
CODE_PATH = r"(?i)\.(py|js|ts|java|go|rb|php|c|cc|cpp|cs|rs|sh|ya?ml|json|toml|ini|cfg|conf|env|properties|xml)$"

#: What ends right before a value that is assigned to a credential's name: the rest of
#: the name, of any length, up to 20 characters more, and the sign. A name is looked at
#: once, from its beginning, so names that repeat these words cost no more than others.
_WORD = CREDENTIAL.replace("(?i)", "(?i:") + ")"
_SIGN = r"""[\w .\-"']{0,20}[=:]{1,2}>?\s{0,3}["']?(?:(?i:bearer|basic)\s)?"""
NAMED = rf"(?<![\w.\-])(?>[\w.\-]*?{_WORD})[\w.\-]*+{_SIGN}"
ASSIGNED = rf"{_WORD}[\w.\-]*+{_SIGN}"
USER_INFO = r"://[^\s:@/?#]*+:?"

#: Fixed noncharacters that mark where values start: after a credential's name and sign,
#: after a URL's user, and at a URL's only user part; the first escapes them in texts.
_ESCAPE, _VALUE, _PASSWORD, _USER = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_MARKS = f"[{_ESCAPE}-{_USER}]"

_RUN = "A-Za-z0-9+/_\\-"
_QUOTED = rf"(?<={{0}}{_VALUE})[^{{0}}\r\n]++(?:(?<=\\){{0}}[^{{0}}\r\n]*+)*+(?={{0}})"
_OPEN = rf"(?:(?<=[\"']{_VALUE})[^\s\"']++|(?<![\"']{_VALUE})[^\s\"'=>]\S*(?<![,;.)\]}}\"']))"
CANDIDATE = "|".join([
    rf"(?<={_VALUE})(?!(?i:bearer|basic)\s)(?:{_QUOTED.format(chr(34))}|{_QUOTED.format(chr(39))}|{_OPEN})",
    rf"(?<={_PASSWORD})[^\s/\"']+(?=@)",
    rf"(?<={_USER})[^\s/:@?#\"']++(?=@)",
    rf"(?<![{_RUN}])(?!//{_USER}?[^\s/@]+@)[{_RUN}]{{16,}}+={{0,2}}",
])

#: Mixed values that identify rather than authorise, and tokens known by their form.
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
HASH = "^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})$"
DATED = r"(^|[-_/])(19|20)[0-9]{2}[-_/]?(0[1-9]|1[0-2])([-_/]?[0-3][0-9])?([-_/]|$)"
PLAIN_PATH = "^/?([a-z][a-z0-9_-]*/){2,}[A-Za-z0-9_-]*$"
KNOWN_TOKEN = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,})$"


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The words of 3 to 12 letters that most documents have."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})\p{L}{3,12}(?!\p{L})"), F.lit(0)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count()
    rows = counts.orderBy(F.desc("count"), "word").limit(words).collect()  # the top words only
    return [row.word for row in rows]


def _dictionary_pattern(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def _marked(text: Column) -> Column:
    """A text with marks where values start that are known by what stands before them."""
    plain = text
    for i, mark in enumerate([_ESCAPE, _VALUE, _PASSWORD, _USER]):
        plain = F.replace(plain, F.lit(mark), F.lit(f"{_ESCAPE}{i}"))
    named = F.regexp_replace(F.when(F.rlike(text, F.lit(_MARKS)), plain).otherwise(text), NAMED, f"$0{_VALUE}")

    def with_users(t: Column) -> Column:
        only = F.regexp_replace(t, r"://(?=[^\s/:@?#\"']++@)", f"$0{_USER}")
        return F.when(F.contains(t, F.lit("://")), F.regexp_replace(only, r"://[^\s:@/?#]*+:", f"$0{_PASSWORD}")).otherwise(t)

    return _with(named, with_users)


def _unmarked(text: Column) -> Column:
    bare = F.regexp_replace(text, f"[{_VALUE}-{_USER}]", "")
    for i, mark in reversed(list(enumerate([_ESCAPE, _VALUE, _PASSWORD, _USER]))):
        bare = F.replace(bare, F.lit(f"{_ESCAPE}{i}"), F.lit(mark))
    return F.when(F.rlike(text, F.lit(_MARKS)), bare).otherwise(text)


def findings_of(text: Column) -> Column:
    """The candidates of a text in order, each with the text right before and after it.

    What is before goes back over the candidate before, which may be the name of this one,
    and holds the whole name of an assigned value. Each text is searched twice, for the
    candidates and for what is between them, however many there are.
    """
    pattern = F.lit(CANDIDATE)

    def between(cut: Column) -> Column:
        def finding(value: Column, i: Column) -> Column:
            gap = F.element_at(cut.gaps, i + 1)
            start = F.concat(F.when(i > 0, F.get(cut.values, i - 1)).otherwise(""), gap)
            name = F.when(F.endswith(gap, F.lit(_VALUE)), F.length(F.regexp_extract(start, f"{NAMED}{_VALUE}$", 0)))
            return F.struct(
                _unmarked(value).alias("value"),
                F.right(_unmarked(start), F.greatest(F.lit(CONTEXT_CHARS), name)).alias("before"),
                F.left(_unmarked(F.element_at(cut.gaps, i + 2)), F.lit(CONTEXT_CHARS)).alias("after"),
            )

        return F.transform(cut.values, finding)

    cut = _with(_marked(text), lambda marked: F.struct(
        F.regexp_extract_all(marked, pattern, F.lit(0)).alias("values"), F.split(marked, CANDIDATE, -1).alias("gaps")
    ))
    return F.coalesce(_with(cut, between), F.array().cast(f"array<{FINDING}>"))


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def _has(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern)).cast("double")


def features(finding: Column, path: Column, words: list[str]) -> Column:
    """What the forest looks at, as an array of doubles."""
    value, before, after = finding.value, finding.before, finding.after
    length = F.length(value)
    known = _dictionary_pattern(words)
    near = F.lower(F.concat(before, F.lit(" "), after))
    shares = [
        _count(value, "[0-9]"),
        _count(value, "[A-Z]"),
        _count(value, "[a-z]"),
        _count(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        _count(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        _count(value, "(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        _count(value, "(?i)[b-df-hj-np-tv-z]{4}"),
        F.size(F.array_distinct(F.split(value, ""))),
        length - F.length(F.regexp_replace(F.lower(value), F.lit(known), F.lit(""))),
        _count(value, "[^A-Za-z0-9+/_=-]"),
    ]
    flags = [
        _has(value, "^[0-9a-fA-F]+$"),
        _has(before, "[=:]\\s*[\"']?$"),
        _has(before, "[\"']$"),
        _has(after, "^[\"']"),
        _has(before, CREDENTIAL),
        _has(F.concat(before, value, after), PLACEHOLDER),
        _has(path, TEST_PATH),
        _has(path, CODE_PATH),
        _has(before, f"{ASSIGNED}$"),
        _has(before, f"{USER_INFO}$") * _has(after, "^@"),
        _has(value, UUID),
    ]
    covered = 1 - F.length(F.regexp_replace(near, F.lit(known), F.lit(""))) / F.greatest(F.length(near), F.lit(1))
    return F.array(
        length.cast("double"),
        *[share / length for share in shares],
        *flags,
        covered,
        _count(path, "/").cast("double"),
    )


#: The rule for findings without both kinds of label, as a tree over the features: what is
#: assigned to a credential's name, has digits and is no placeholder; or is URL user info.
RULE = [19, 0.5, [20, 0.5, 0.0, 1.0], [1, 0.0, 0.0, [16, 0.5, 1.0, 0.0]]]


def train(labelled: DataFrame, words: list[str], train_rows: int = TRAIN_ROWS) -> list:
    """The trees of a forest fitted on labelled findings, as nested lists.

    ``labelled`` has ``value``, ``before``, ``after``, ``path`` and ``label`` (1 for a
    secret). Of more rows, those first by a hash are taken, half of them of each label;
    both labels weigh the same.
    A tree is a vote (0 or 1), or a list of feature, threshold, and the trees for values
    up to it and above it.
    """
    finding = F.struct("value", "before", "after")
    kept = labelled.where("label in (0, 1)").na.fill("", ["value", "before", "after", "path"])
    kept = stored(kept.select("value", "before", "after", "path", "label"), "labelled")
    order = F.xxhash64("value", "before", "after", "path"), F.col("value"), F.col("before")
    halves = [first_by_hash(kept.where(F.col("label") == label), train_rows // 2, *order) for label in (0, 1)]
    rows = halves[0].unionByName(halves[1]).select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(features(finding, F.col("path"), words)).alias("features"),
    ).cache()
    try:
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
        if len(counts) < 2:
            return [RULE] if counts else [0.0]
        weight = F.when(F.col("label") == 1, counts[0.0] / counts[1.0]).otherwise(1.0)
        forest = RandomForestClassifier(numTrees=N_TREES, maxDepth=MAX_DEPTH, seed=7, weightCol="weight")
        model = forest.fit(rows.withColumn("weight", weight))
        return [_tree(tree._java_obj.rootNode()) for tree in model.trees]
    finally:
        rows.unpersist()


def _tree(node) -> list | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return [split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())]


def score(values: Column, trees: list) -> Column:
    """The share of trees that call a finding with these features a secret."""

    def vote(tree: list | float) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, below, above = tree
        return F.when(values[feature] <= threshold, vote(below)).otherwise(vote(above))

    total = F.lit(0.0)
    for tree in trees:
        total = total + vote(tree)
    return total / len(trees)


def scan(docs: DataFrame, trees: list, words: list[str], path: str = "source") -> DataFrame:
    """``docs`` with ``findings``: value, before, after, score and ``is_secret``, in order."""
    where = F.coalesce(F.col(path).cast("string"), F.lit(""))
    described = F.transform(findings_of(F.col("text")), lambda f: F.struct(
        f.value.alias("value"), f.before.alias("before"), f.after.alias("after"),
        features(f, where, words).alias("x"),
    ))
    scored = F.transform(described, lambda f: F.struct(
        f.value.alias("value"), f.before.alias("before"), f.after.alias("after"),
        score(f.x, trees).alias("score"),
    ))
    judged = F.transform(scored, lambda f: F.struct(
        f.value.alias("value"), f.before.alias("before"), f.after.alias("after"),
        f.score.alias("score"), (f.score > 0.5).alias("is_secret"),
    ))
    return docs.select(*[c for c in docs.columns if c != "findings"], judged.alias("findings"))


def redact(scanned: DataFrame, mask: str = MASK) -> DataFrame:
    """The scanned documents with ``mask`` in the place of each secret, without ``findings``."""
    gaps = F.split(_marked(F.col("text")), CANDIDATE, -1)
    shown = F.transform(
        "findings", lambda f: F.when(f.is_secret, F.lit(mask)).otherwise(f.value)
    )
    pieces = F.zip_with(gaps, shown, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    text = F.when(F.exists("findings", lambda f: f.is_secret), _unmarked(F.array_join(pieces, ""))).otherwise(F.col("text"))
    return scanned.withColumn("text", text).drop("findings")


def rule_labels(docs: DataFrame, path: str = "source") -> DataFrame:
    """Findings labelled by plain rules, for corpora without reviewed ones.

    A value of mixed letters and digits that is assigned to a credential's name or is the
    password of a URL is a secret, and so is one of a known form. In other surroundings
    a value of letters alone or digits alone, a hash, a UUID, a dated slug, a path and a
    placeholder are none. Others have no label. Surroundings stay as they are.

    So that the forest always sees values that are hard to tell from secrets, each document
    adds one hash, UUID, slug or path made from its text, in its own surroundings; and each
    value of letters or digits alone comes again in a credential's assignment.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")
    found = docs.select(where, F.explode(findings_of(F.col("text"))).alias("f")).select("path", "f.*")

    def is_like(column: str, pattern: str) -> Column:
        return F.rlike(column, F.lit(pattern))

    mixed = is_like("value", "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
    in_url = is_like("before", f"{USER_INFO}$") & is_like("after", "^@")
    assigned = is_like("before", f"{ASSIGNED}$") | in_url
    plain = is_like("value", "^([A-Za-z_+/\\-]+|[0-9\\-]+)=*$")
    placeholder = is_like("value", PLACEHOLDER)
    code = is_like("value", r"[(){}\[\]$<>]") & ~is_like("before", "[\"']$")
    hard = F.lit(False)
    for pattern in (UUID, HASH, DATED, PLAIN_PATH, PLACEHOLDER):
        hard = hard | is_like("value", pattern)
    known = is_like("value", KNOWN_TOKEN)
    label = (
        F.when(((mixed & assigned) | known) & ~placeholder & ~code, 1)
        .when(plain & ~assigned, 0)
        .when(hard & ~assigned & ~is_like("before", CREDENTIAL), 0)
    )
    again = F.struct("value", F.lit('token = "').alias("before"), F.lit('"').alias("after"))
    own = F.struct("value", "before", "after")
    both = F.explode(F.when((F.col("label") == 0) & plain, F.array(own, again)).otherwise(F.array(own))).alias("f")
    labelled = found.withColumn("label", label).where("label is not null").select("path", "label", both)
    return labelled.select("path", "label", "f.*").unionByName(_hard_negatives(docs, where))


def _hard_negatives(docs: DataFrame, path: Column) -> DataFrame:
    """One mixed value that is no secret for each document, between the words of its text."""
    start = F.left("text", F.lit(400))
    h = F.xxhash64(start)
    words = F.slice(F.regexp_extract_all(F.lower(start), F.lit("[a-z]{3,}"), F.lit(0)), 1, 3)

    def number(shift: int, of: int, first: int) -> Column:
        return F.lpad((F.pmod(F.shiftright(h, shift), F.lit(of)) + first).cast("string"), 2, "0")

    date = F.concat_ws("-", F.concat(F.lit("20"), number(3, 30, 0)), number(9, 12, 1), number(15, 28, 1))
    made = F.array(
        F.sha1(start.cast("binary")),
        F.sha2(start.cast("binary"), 256),
        F.md5(start.cast("binary")),
        F.regexp_replace(F.md5(start.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.concat(date, F.lit("-"), F.array_join(words, "-")),
        F.concat(F.lit("/"), F.array_join(words, "/"), F.lit("/"), F.replace(date, F.lit("-"), F.lit("/"))),
    )
    names = F.array(*[F.lit(x) for x in ("", "", "commit ", "sha256: ", 'id = "', 'checksum="', "rev: ")])
    name = F.get(names, F.pmod(F.shiftright(h, 21), F.lit(7)))
    real = F.regexp_extract(F.get(F.split(start, CREDENTIAL, 2), F.lit(0)), r"(?s)^(.{0,47}\s)", 1)
    after = F.concat(F.when(name.endswith('"'), F.lit('" ')).otherwise(F.lit(" ")), F.substr("text", F.length(real) + 1, F.lit(60)))
    return docs.where(F.size(words) == 3).select(
        path, F.lit(0).alias("label"), F.get(made, F.pmod(F.shiftright(h, 27), F.lit(6))).alias("value"),
        F.concat(real, name).alias("before"), after.alias("after"),
    )
