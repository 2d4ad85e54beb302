"""Secrets in texts: candidates by patterns, false positives removed by a random forest.

Candidates are whole values assigned to telling names, of any length and characters, keys in issued formats, and longer runs
with a digit. A value also counts as a secret if a key or run inside it does.

A candidate is described by its length, its changes between kinds of characters, how much of it dictionary words cover, the
path of its document and its neighbouring words. The forest is fitted by Spark's own learner on a bounded sample of
labelled findings and then written out as one SQL expression, which scores all candidates of a row in place. All of it is
DataFrame functions; scanning shuffles nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

#: Findings that the forest is fitted on at most.
SAMPLE_ROWS = 20_000
#: Characters of the text on either side that count as neighbourhood.
CONTEXT = 48
MASK = "[SECRET]"

#: Formats that some issuers give their keys, and names that tell that a secret is assigned to them.
FORMATS = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
ISSUED = rf"^{FORMATS}$"
NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
_LEAD = rf"{NAMES}[\"']?+\s*+[=:]++>?+\s*+"
ASSIGNED = rf"{_LEAD}[\"']?$"
# A run of 12 or more of these characters with a digit, from its start to its last letter or digit; an issued format also without a digit.
_RUN = r"A-Za-z0-9+/_.@-"
CANDIDATE = rf"(?<![A-Za-z0-9])(?:(?<![+/_.@-])(?=[A-Za-z+/_.@-]*+[0-9])[{_RUN}]{{11,}}[A-Za-z0-9](?![A-Za-z0-9])={{0,2}}|{FORMATS}(?![A-Za-z0-9]))"
# An assignment to a telling name (1) and the whole value (2): to the quote that closes it in its line, else to a blank or quote. Quotes
# may be escaped; the expression's stack allows 500 backslashes, beyond which a value ends like one that no quote closes.
_CLOSED = "|".join(rf"(?<={q})(?!{q})[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+){{0,500}}(?={q})" for q in "\"'")
ASSIGNMENT = rf"((?i:{_LEAD})[\"']?+)({_CLOSED}|[^\s\"']+)"
#: What every assignment holds; quickly looked for, so that other texts are spared the expression above.
_HINT = r"[dtnylhDTNYLH][\"']?+\s*+[=:]"
_MAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\W*$"
#: Words that don't make a secret.
DICTIONARY = (
    "account admin also and api apple archive article blog body book build change class client code com content copy data date default demo "
    "dev doc dummy edit email error example false file first for foo form from get group header home host html http id image index "
    "info item key last link list local log mail main map me message mobile model name net new news number object of office old on open org "
    "page part password path phone photo placeholder port post print product query read release sample search server set site size source "
    "start state string support system table tag test text the time title token true type update upload url user value version video view "
    "web with work www xml xxx your"
).split()
FEATURES = (
    "length", "changes", "digits", "upper", "lower", "other", "distinct", "covered", "vowels", "dots", "at", "named", "assigned", "quoted", "words_left",
    "test_path", "path_length",
)


def _share(c: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(c: Column, left: Column, right: Column, path: Column) -> Column:
    """The values of ``FEATURES`` for a candidate between the texts ``left`` and ``right``."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    flag = lambda x: x.cast("double")
    return F.array(
        F.length(c).cast("double"), (F.length(kinds) - 1) / F.length(c), _share(c, "[0-9]"), _share(c, "[A-Z]"), _share(c, "[a-z]"), _share(c, "[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) / F.length(c), _share(F.lower(c), words), _share(F.lower(c), "[aeiou]"),
        F.length(F.regexp_replace(c, "[^.]", "")).cast("double"), flag(F.contains(c, F.lit("@"))),
        flag(F.lower(left).rlike(rf"{NAMES}\W*$")), flag(left.rlike(r"[=:]\s*[\"']?$")), flag(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        F.size(F.split(F.trim(left), r"\s+")).cast("double"), flag(F.lower(path).rlike(r"test|example|sample|fixture|docs?/")), F.length(path).cast("double"),
    )


def _telling(text: Column) -> Column:
    return text.rlike(_HINT) & text.rlike(ASSIGNMENT)


def _matched(rows: DataFrame) -> DataFrame:
    """``rows`` with the candidates of ``text``, ``cands``, and what lies before, between and behind them, ``gaps``.

    Values of assignments come first; the other candidates are looked for in what lies between the values.
    """
    text = F.coalesce("text", F.lit(""))
    leads, values = (F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(k)) for k in (1, 2))
    between = F.zip_with(F.split(text, ASSIGNMENT, -1), leads, lambda gap, lead: F.concat(gap, F.coalesce(lead, F.lit(""))))
    cut = rows.withColumn("between", F.when(_telling(text), F.struct(between.alias("texts"), values.alias("values"))))
    texts, values = F.col("between.texts"), F.col("between.values")
    found = lambda s: F.regexp_extract_all(s, F.lit(CANDIDATE), F.lit(0))
    parts = lambda s: F.split(s, CANDIDATE, -1)
    cands = F.flatten(F.zip_with(texts, values, lambda s, value: F.when(value.isNull(), found(s)).otherwise(F.concat(found(s), F.array(value)))))
    gaps = F.flatten(F.transform(texts, parts))
    plain = F.col("between").isNull()
    return cut.withColumn("gaps", F.when(plain, parts(text)).otherwise(gaps)).withColumn("cands", F.when(plain, found(text)).otherwise(cands)).drop("between")


def _inside(c: Column, left: Column, right: Column, path: Column) -> Column:
    """The features of candidates that a longer value holds, in their own neighbourhood."""
    found, gaps = F.regexp_extract_all(c, F.lit(CANDIDATE), F.lit(0)), F.split(c, CANDIDATE, -1)

    def one(x: Column, k: Column) -> Column:
        before = F.when(k == 0, F.concat(left, gaps[0])).otherwise(F.get(gaps, k))
        behind = F.when(k == F.size(found) - 1, F.concat(F.get(gaps, k + 1), right)).otherwise(F.get(gaps, k + 1))
        return features(x, F.substring(before, -CONTEXT, CONTEXT), F.substring(behind, 1, CONTEXT), path)

    return F.when(~c.rlike(rf"^(?:{CANDIDATE})$"), F.transform(found, one)).otherwise(F.array().cast("array<array<double>>"))


def candidates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id``, ``text``, ``gaps`` and ``found`` (``secret``, ``start``, ``left``, ``right``, ``features``, and ``inside``, those of candidates in a
    value); ``found`` is empty without candidates."""
    rows = docs.select(
        F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(path).cast("string") if path else F.lit(""), F.lit("")).alias("path")
    )
    split = _matched(rows)
    n = F.size("cands")
    zipped = F.arrays_zip(F.col("cands").alias("c"), F.slice("gaps", F.lit(1), n).alias("l"), F.slice("gaps", F.lit(2), n).alias("r"))
    empty = F.array().cast("array<struct<secret:string,start:int,left:string,right:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["l"])
        one = F.struct(z["c"].alias("secret"), start.alias("start"), F.substring(z["l"], -CONTEXT, CONTEXT).alias("left"), F.substring(z["r"], 1, CONTEXT).alias("right"))
        return F.struct((start + F.length(z["c"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    found = F.aggregate(zipped, first, step, lambda s: s["out"])
    named = ("secret", "left", "right")
    described = lambda f: F.struct(
        *[f[k].alias(k) for k in ("secret", "start", "left", "right")],
        *[kind(*[f[k] for k in named], F.col("path")).alias(name) for kind, name in ((features, "features"), (_inside, "inside"))],
    )
    listed = split.withColumn("found", F.when(n > 0, found).otherwise(empty))
    return listed.withColumn("found", F.transform("found", described)).select("id", "text", "gaps", "found")


def findings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per candidate: ``id``, ``secret``, ``start``, ``left``, ``right``, ``features`` and ``inside``."""
    whole = F.col(text).cast("string")
    some = docs.where(whole.rlike(CANDIDATE) | _telling(whole))
    return candidates(some, id=id, text=text, path=path).select("id", F.explode("found").alias("f")).select("id", "f.*")


def strict_label() -> Column:
    """1 for ``findings`` in an issued format or assigned to a telling name and hardly made of words, else 0."""
    secret, left = F.col("secret"), F.col("left")
    plain = _share(F.lower(secret), "|".join(w for w in DICTIONARY if len(w) > 3)) > 0.5
    return (secret.rlike(ISSUED) | (F.lower(left).rlike(ASSIGNED) & ~plain & ~secret.rlike(_MAIL))).cast("double")


@dataclass(frozen=True)
class Forest:
    """Trees as nested lists: ``[feature, threshold, at most, above]``, or a leaf's vote."""

    trees: tuple

    def score(self, x: Column) -> Column:
        def vote(node) -> Column:
            if not isinstance(node, list):
                return F.lit(float(node))
            k, threshold, low, high = node
            return F.when(x[k] <= F.lit(threshold), vote(low)).otherwise(vote(high))

        return sum((vote(t) for t in self.trees[1:]), vote(self.trees[0])) / len(self.trees)

    def highest(self, found: Column) -> Column:
        """The score of a candidate, or of the likeliest secret inside it."""
        return F.array_max(F.transform(F.concat(F.array(found["features"]), found["inside"]), self.score))

    def to_json(self) -> str:
        return json.dumps(self.trees)


def _tree(text: str):
    """A tree from the learner's printed form."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]

    def node():
        line = lines.pop(0)
        if leaf := re.match(r"Predict: (\S+)", line):
            return float(leaf[1])
        k, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        lines.pop(0)  # Else
        return [int(k), float(threshold), low, node()]

    return node()


def fit(labelled: DataFrame, *, rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 6) -> Forest:
    """A forest from findings with ``features`` and ``label`` (0 or 1).

    It is fitted on ``rows`` findings at most, those with the smallest hashes of all their columns. Findings without label are
    left out. Without a finding nothing counts as a secret; with labels of one kind only, every finding has that label.
    """
    names = [c for c in labelled.columns if c not in ("features", "inside", "label")]
    chosen = labelled.where("label is not null").select("features", F.col("label").cast("double").alias("label"), F.xxhash64(*names, "features").alias("at"))
    chosen = chosen.orderBy("at", "label").limit(rows).coalesce(1).sortWithinPartitions("at", "label").select(array_to_vector("features").alias("features"), "label").cache()
    kinds = [r.label for r in chosen.select("label").distinct().collect()]
    if len(kinds) < 2:
        chosen.unpersist()
        return Forest((kinds[0] if kinds else 0.0,))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, maxBins=64).fit(chosen)
    chosen.unpersist()
    return Forest(tuple(_tree(t.toDebugString) for t in model.trees))


def scan(docs: DataFrame, forest: Forest, *, id: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, ``start`` (in characters, from 0), ``length``, ``secret``, ``score`` (share of the trees that vote for a
    secret) and ``is_secret`` (a score of at least ``threshold``).

    Whole texts are read. Null and empty texts have no candidates; repeated rows give repeated findings; rows without id keep
    their null. Other columns are not read. An empty table gives an empty one.
    """
    scored = findings(docs, id=id, text=text, path=path).withColumn("score", forest.highest(F.struct("features", "inside")))
    return scored.select(F.col("id").alias(id), "start", F.length("secret").alias("length"), "secret", "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, forest: Forest, *, text: str = "text", path: str | None = None, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by ``mask``; all other columns and rows stay as they are, in place."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("id"), F.col(f"`{text}`").alias("text"), (F.col(f"`{path}`") if path else F.lit("")).alias("path"))
    listed = candidates(rows, id="id", text="text", path="path")
    shown = F.transform(listed["found"], lambda f: F.when(forest.highest(f) >= threshold, F.lit(mask)).otherwise(f["secret"]))
    parts = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("found")).alias("l"), F.col("shown").alias("c"))
    joined = F.concat(F.array_join(F.transform(parts, lambda z: F.concat(z["l"], z["c"])), ""), F.element_at("gaps", -1))
    kept = listed.withColumn("shown", shown).withColumn("new", F.when(F.size("found") > 0, joined).otherwise(F.col("text")))
    return kept.select(*[(F.col("new") if c == text else F.col(f"id.`{c}`")).alias(c) for c in docs.columns])
