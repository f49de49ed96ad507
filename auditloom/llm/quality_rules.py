"""Operator 3 [native], quality rules by weak supervision.

Every text is measured once, by DataFrame functions only. Nine rules read the measures, and each votes keep (1),
reject (-1) or abstains (0). How good the rules are isn't assumed: expectation-maximisation over all documents
that the base rules let pass estimates, for good and for bad ones, how often each rule casts each vote, and the share of good ones. A document's
posterior probability of being good then follows from its votes, and ``kept`` is posterior >= 1/2 unless the base
rules fail it outright.

The documents meet only in one aggregation, the number of documents for each combination of votes: at most 3**9 = 19683
rows whatever the corpus, pre-aggregated before its shuffle. EM runs on those counts (``fit``) and gives a few
logarithms that go back into a column expression (``judged``). One prior makes two classes of EM mean good and bad: a rule rejects ``FALSE_REJECTS`` of the
good documents at most. It holds for *trusted* rules only, those that reject few documents alone (``MAX_ALONE``); a rule that often rejects what all other rules keep
has no such bound, EM finds its rejects to be no sign of badness, and the others outvote it. All measures of a document are taken within its row, so no
group of documents meets in a task. Repeated 8-word windows cost one sort of hashes a text; equal hashes are verified
word by word, so collisions don't count.

Cases: a null or empty text has no words and fails the base rules; null or repeated ids are kept, row by row; an empty
table gives an empty result (EM then stays at its priors); columns of ``docs`` named like an output are replaced by it. Very long texts are measured whole, by one
sort of a long a window; a window's place has 30 bits, so a text may have 2**30 words, more than a text of Spark's (2**31 bytes) has of the length of two.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, without

#: Frequent function words of English, German, French and Spanish, in lower case and capitalised.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "it", "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "pour", "dans", "el", "los", "las", "de", "que", "y", "por", "con", "para", "su"]
WINDOW = 8
#: (rule, condition of a reject vote, condition of a keep vote), in SQL over the measures; whole-number arithmetic, so that every engine agrees.
RULES = [
    ("symbols", "10 * n_symbols > 3 * n_words", "20 * n_symbols <= n_words"),
    ("shouting", "10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars"),
    ("exclamation", "4 * n_bang > n_words", "25 * n_bang <= n_words"),
    ("repetition", "100 * n_repeat_words > 28 * n_words", "10 * n_repeat_words <= n_words"),
    ("stutter", "5 * n_stutter > n_words", "20 * n_stutter <= n_words"),
    ("lines", "2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("stop_words", "n_stop = 0 AND n_words >= 40", "n_stop >= 2"),
    ("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars"),
]
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_lines", "n_stop", "n_letters", "n_stutter"]
OUTPUT = [*MEASURES, "base_failed", "posterior", "kept"]
#: Pseudo-documents of the priors, and the prior votes (keep, abstain, reject) of a rule on good and on bad documents.
PRIOR_DOCS, PRIOR_GOOD = 20.0, 0.9
PRIOR_VOTES = {True: (0.949, 0.05, 0.001), False: (0.75, 0.05, 0.2)}
#: A bound on what EM may believe: no trusted rule rejects more than this share of the good documents. Without it a kind of badness that no
#: second rule confirms drifts into the good class as EM goes on, since nothing else sets it apart.
FALSE_REJECTS = 0.002
#: A rule that alone rejects more than this share of the documents isn't trusted: badness that common would show in some other rule too.
MAX_ALONE = 0.05
ITERATIONS = 20


def _stop_words() -> list[str]:
    return sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})


def _neighbours_equal(items: Column, key) -> Column:
    """Elements of a sorted array whose key equals that of the element before or after."""
    none = F.lit(False)
    return F.filter(items, lambda x, i: F.coalesce(key(x) == key(F.get(items, i - 1)), none) | F.coalesce(key(x) == key(F.get(items, i + 1)), none))


def repeated_words(w: Column) -> Column:
    """Words within WINDOW-word windows that the word array ``w`` (a lambda variable or attribute) holds twice or more."""
    low = (1 << 30) - 1
    # A window's place in the low 30 bits, 34 bits of its hash above: equal hashes are neighbours once sorted.
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    suspects = let(F.sort_array(hashed), lambda s: _neighbours_equal(s, lambda x: F.shiftright(x, 30)))
    spelled = F.transform(suspects, lambda x: let(x.bitwiseAND(F.lit(low)).cast("int"), lambda p: F.struct(F.array_join(F.slice(w, p + 1, WINDOW), " ").alias("words"), p.alias("place"))))
    proven = let(F.sort_array(spelled), lambda s: _neighbours_equal(s, lambda x: x["words"]))
    places = F.sort_array(F.transform(proven, lambda x: x["place"]))
    covered = let(places, lambda q: F.aggregate(F.transform(q, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(q, i - 1)))), F.lit(0), lambda a, b: a + b))
    return F.when(F.size(w) >= WINDOW, covered).otherwise(0)


def _measure(text: Column) -> Column:
    def of(t: Column, w: Column, lines: Column) -> Column:
        gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": gone(r"[#*$%&|<>]"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
            "n_upper": gone(r"\p{Lu}"),
            "n_bang": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
            "n_lines": F.size(lines),
            "n_stutter": F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))),
            "n_letters": gone(r"\p{L}"),
            "n_stop": F.size(F.array_intersect(w, F.array(*map(F.lit, _stop_words())))),
        }
        return F.struct(*[found[m].cast("long").alias(m) for m in MEASURES])

    split = lambda t: F.array_remove(F.split(t, SPACES), "")
    with_words = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.coalesce(text, F.lit("")), lambda t: let(split(t), lambda w: let(with_words(t), lambda lines: of(t, w, lines))))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures and the votes (array<int>, in the order of RULES) of each text."""
    own = without(docs, *OUTPUT, "votes", "__measures").withColumn("__measures", _measure(docs[text_col].cast("string")))
    own = own.select("*", *[F.col(f"__measures.{m}") for m in MEASURES]).drop("__measures")
    votes = [f"CASE WHEN {reject} THEN -1 WHEN {keep} THEN 1 ELSE 0 END" for _, reject, keep in RULES]
    return own.withColumn("votes", F.expr(f"array({', '.join(votes)})"))


@dataclass
class Model:
    """Share of good documents; for each rule and class the probabilities of the votes (1, 0, -1)."""

    good: float = PRIOR_GOOD
    trusted: tuple[bool, ...] = (True,) * len(RULES)
    votes: list[dict[bool, tuple[float, float, float]]] = field(default_factory=lambda: [dict(PRIOR_VOTES) for _ in RULES])

    def weight(self, rule: int, vote: int) -> float:
        """Log odds that a vote adds; a keep vote never counts against a document, a reject vote never for it."""
        odds = math.log(self.votes[rule][True][1 - vote] / self.votes[rule][False][1 - vote])
        return max(odds, 0.0) if vote > 0 else min(odds, 0.0) if vote < 0 else odds

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.good / (1 - self.good)) + sum(self.weight(j, v) for j, v in enumerate(votes))

    def accuracies(self) -> dict[str, float]:
        """For each rule the probability that a vote it casts is right."""
        out = {}
        for (name, _, _), by in zip(RULES, self.votes, strict=True):
            right = self.good * by[True][0] + (1 - self.good) * by[False][2]
            cast = right + self.good * by[True][2] + (1 - self.good) * by[False][0]
            out[name] = right / cast
        return out


def trusted(counts: dict[tuple[int, ...], int]) -> tuple[bool, ...]:
    """Whether each rule rejects few documents alone."""
    total = sum(counts.values())
    alone = [sum(n for votes, n in counts.items() if votes[j] == -1 and votes.count(-1) == 1) for j in range(len(RULES))]
    return tuple(n <= MAX_ALONE * total for n in alone)


def fit_counts(counts: dict[tuple[int, ...], int]) -> Model:
    """EM from the start "good unless a trusted rule rejects it"; ITERATIONS steps, maximum a posteriori."""
    rows = sorted(counts.items())
    model = Model(trusted=trusted(counts))
    good = [0.1 if any(v == -1 and sure for v, sure in zip(votes, model.trusted, strict=True)) else 0.9 for votes, _ in rows]
    prior = PRIOR_DOCS
    for _ in range(ITERATIONS):
        total = {True: sum(n * p for (_, n), p in zip(rows, good, strict=True)), False: sum(n * (1 - p) for (_, n), p in zip(rows, good, strict=True))}
        model.good = (total[True] + prior * PRIOR_GOOD) / (total[True] + total[False] + prior)
        for j in range(len(RULES)):
            for cls in (True, False):
                model.votes[j][cls] = tuple(
                    (sum(n * (p if cls else 1 - p) for (votes, n), p in zip(rows, good, strict=True) if votes[j] == v) + prior * PRIOR_VOTES[cls][1 - v]) / (total[cls] + prior) for v in (1, 0, -1)
                )
            keep, abstain, reject = model.votes[j][True]
            model.votes[j][True] = (keep, abstain, min(reject, FALSE_REJECTS) if model.trusted[j] else reject)
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes))))) for votes, _ in rows]
    return model


def fit(measures: DataFrame) -> Model:
    """EM over all documents; what reaches the driver is a count for each combination of votes, 3**9 at most."""
    # No filter on the measures: the optimizer would work them out once more in it, for each measure that it names.
    rows = measures.groupBy("votes", F.expr(BASE_FAILED).alias("base_failed")).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_counts({tuple(r["votes"]): r["n"] for r in rows if not r["base_failed"]})


def accuracy_table(spark, model: Model) -> DataFrame:
    """rule, accuracy (probability that a vote it casts is right), false_rejects (share of the good documents it rejects), trusted: a row a rule."""
    found = model.accuracies()
    rows = [(name, found[name], model.votes[j][True][2], model.trusted[j]) for j, (name, _, _) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule string, accuracy double, false_rejects double, trusted boolean")


def judged(measures: DataFrame, model: Model) -> DataFrame:
    """``measures`` with base_failed, posterior (of being good) and kept."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for j in range(len(RULES)):
        vote = F.get(F.col("votes"), F.lit(j))
        odds = odds + F.when(vote == 1, model.weight(j, 1)).when(vote == -1, model.weight(j, -1)).otherwise(model.weight(j, 0))
    return measures.withColumns({"base_failed": F.expr(BASE_FAILED), "__odds": odds}).select("*", F.round(1 / (1 + F.exp(-F.col("__odds"))), 6).alias("posterior"), (~F.col("base_failed") & (F.col("__odds") >= 0)).alias("kept")).drop("__odds")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with just its own columns (whatever their names)."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    measures = measured(boxed)
    verdict = judged(measures, fit(measures)).select(F.struct("__doc", "kept").alias("r"))
    # A plain filter on ``kept`` would be pushed below the projections, which inlines the whole measurement in it dozens of times.
    return verdict.select(F.explode(F.filter(F.array("r"), lambda r: r["kept"])).alias("r")).select("r.__doc.*")


def em_sql(measures: str) -> str:
    """DuckDB SQL of the CTEs from a relation of measures to ``judged`` (id columns and measures pass through)."""
    n = len(RULES)
    votes = ", ".join(f"CASE WHEN {reject} THEN -1 WHEN {keep} THEN 1 ELSE 0 END AS v{j}" for j, (_, reject, keep) in enumerate(RULES))
    vs = ", ".join(f"v{j}" for j in range(n))
    out = [f"voted AS MATERIALIZED (SELECT *, {votes} FROM {measures})", f"counts AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY {vs})"]
    rejects = " + ".join(f"(v{j} = -1)::INT" for j in range(n))
    alone = ", ".join(f"coalesce(sum(n) FILTER (WHERE v{j} = -1 AND {rejects} = 1), 0) <= {MAX_ALONE!r}::DOUBLE * coalesce(sum(n), 0) AS t{j}" for j in range(n))
    out.append(f"trust AS MATERIALIZED (SELECT {alone} FROM counts)")
    out.append(f"post0 AS MATERIALIZED (SELECT counts.*, CASE WHEN {' OR '.join(f'(v{j} = -1 AND t{j})' for j in range(n))} THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS p FROM counts, trust)")

    def weight(j: int, m: str) -> str:
        odds = {v: f"ln({m}.g{j}_{1 - v} / {m}.b{j}_{1 - v})" for v in (1, 0, -1)}
        return f"CASE v{j} WHEN 1 THEN greatest({odds[1]}, 0) WHEN -1 THEN least({odds[-1]}, 0) ELSE {odds[0]} END"

    odds = lambda m: f"ln({m}.good / (1 - {m}.good)) + " + " + ".join(weight(j, m) for j in range(n))
    prior = f"{PRIOR_DOCS!r}::DOUBLE"
    for k in range(ITERATIONS):
        cells = []
        for j in range(n):
            for cls, share in (("g", "p"), ("b", "1 - p")):
                for v in (1, 0, -1):
                    vote = PRIOR_VOTES[cls == "g"][1 - v]
                    cell = f"(coalesce(sum(n * ({share})) FILTER (WHERE v{j} = {v}), 0) + {prior} * {vote!r}::DOUBLE) / (coalesce(sum(n * ({share})), 0) + {prior})"
                    cells.append((f"CASE WHEN (SELECT t{j} FROM trust) THEN least({cell}, {FALSE_REJECTS!r}::DOUBLE) ELSE {cell} END" if cls == "g" and v == -1 else cell) + f" AS {cls}{j}_{1 - v}")
        out.append(f"model{k} AS MATERIALIZED (SELECT (coalesce(sum(n * p), 0) + {prior} * {PRIOR_GOOD!r}::DOUBLE) / (coalesce(sum(n), 0) + {prior}) AS good, {', '.join(cells)} FROM post{k})")
        if k < ITERATIONS - 1:
            out.append(f"post{k + 1} AS MATERIALIZED (SELECT {vs}, n, 1 / (1 + exp(-greatest(-500, least(500, {odds('m')})))) AS p FROM post{k}, model{k} m)")
    out.append(f"judged AS (SELECT voted.*, {BASE_FAILED} AS base_failed, {odds('m')} AS odds FROM voted, model{ITERATIONS - 1} m)")
    return ",\n".join(out)


def oracle_sql() -> str:
    """DuckDB SQL with the rows of the query op3."""
    stop = ", ".join(f"'{w}'" for w in _stop_words())
    windows = f"list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i+{WINDOW - 1}], ' '))"
    return f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS MATERIALIZED (SELECT r, unnest({windows}) AS s, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM texts WHERE len(w) >= {WINDOW}),
repeated AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, i - coalesce(before, i - {WINDOW})))::BIGINT AS n FROM repeated GROUP BY r),
measures AS MATERIALIZED (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bang, len(lines)::BIGINT AS n_lines,
         len(list_intersect(list_distinct(w), [{stop}]))::BIGINT AS n_stop, (length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')))::BIGINT AS n_letters,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
  FROM texts LEFT JOIN covered USING (r)),
{em_sql('measures')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND odds >= 0) AS kept, round(1 / (1 + exp(-odds)), 6) AS posterior FROM judged"""
