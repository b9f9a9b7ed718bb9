"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Four base kinds are exact rules (a pattern and a check).  Two generators
with high recall propose further, overlapping spans: runs of digits with
separators (``number``) and long runs of letters and digits (``secret``).
Each candidate has small, binned features of its format and of its
context: credential or contact words before it, an assignment, quotes.

Gradient-boosted depth-two trees are trained on a weak label that no
feature holds: a secret is positive when it looks random (its characters
change between digits, lower and upper case in ``RANDOM`` of the places),
a number when its digits pass Luhn's check whatever stands between them.
Candidates of all documents are aggregated to one row per feature vector
(a bounded number of rows, the product of the bins), so boosting on the
driver uses all data at a fixed size.

Thresholds are calibrated per context.  ``PRIOR`` states how much a
positive label is worth there: what looks random right behind an assigned
credential word is a secret, elsewhere it is mostly a checksum or an
identifier.  The threshold of a context is the least score from which the
label's share, times the prior, reaches ``PRECISION`` among the candidates
of that context, however few they are; a context whose prior is below it
accepts nothing.  So neither hashes elsewhere nor the size of the table
decide on a secret, but its format does: an assigned word is none.
Candidates so accepted that overlap no base span are added; base spans stay.

Everything else is column expressions on the document's row: positions
are prefix sums over the pieces between matches, taken in blocks, and no
row is shuffled.  Patterns that could start inside a run are anchored at
the run's start (or at the last match), so scanning is linear.

Defined cases: null text is the empty text without spans; equal texts
have equal spans; an empty table gives an empty result and trains nothing
(base spans only); other columns pass by, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tavolo.llm.common import kept

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret")
KINDS = BASE + ADDED
# The base rules.  (?:(?<!x)|\G) starts a match at a run's start or after the last match.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the generators
    # digits with signs between them go in pieces of at most 24, digits alone in one
    "number": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:(?:[\x20().-]{0,2}[0-9]){8,23}|[0-9]{24,}+)(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
CREDENTIAL = r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|passwd|password|pwd|bearer)[\x20\"'*#%&$!]{0,6}[:=][\x20\"']{0,3}$"
CREDENTIAL_WORD = r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|passwd|password|pwd|bearer)"
CONTACT = r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|account|iban|contact|mail)\b"
BLOCK = 256             # pieces whose lengths are summed together
PRECISION = 0.95
RANDOM = 0.15           # share of places at which a random run changes between digits, lower and upper case
# worth of a positive label by context: secrets without, near and assigned to a credential word; numbers without
# and with a contact word (Luhn's check alone lets one number in ten pass, so the label's share speaks for itself)
PRIOR = {"secret": (0.01, 0.5, 1.0), "number": (1.0, 1.0)}
ROUNDS, RATE = 12, 0.5
CONTEXT = 24            # characters looked at on either side
BINS = {"number": {"digits": 6, "spaces": 3, "signs": 3, "plus": 2, "before": 4, "after": 4, "contact": 2},
        "secret": {"digits": 6, "letters": 4, "cases": 3, "length": 5, "before": 4, "after": 4, "credential": 3}}
CONTEXT_FEATURE = {"number": "contact", "secret": "credential"}
SPAN = "struct<kind:string,start:int,stop:int,found:string,before:string,after:string>"


def _place(text: str, kind: str) -> str:
    """SQL: array of spans of a kind in the column ``text`` (empty without any)."""
    pattern = PATTERN[kind].replace("\\", "\\\\").replace("'", "\\'")
    total = "(a, v) -> a + v"
    # lengths of piece and match, their sums by block, and the running sum before each match
    return f"""
      transform(array(struct(regexp_extract_all({text}, '{pattern}', 0) as f, split({text}, '{pattern}', -1) as p)), x ->
      transform(array(struct(x.f as f, x.p as p, transform(x.f, (m, i) -> length(get(x.p, i)) + length(m)) as n)), y ->
      transform(array(struct(y.f as f, y.p as p, y.n as n,
          transform(sequence(0, div_floor(size(y.f))), b ->
              aggregate(slice(y.n, b * {BLOCK} + 1, {BLOCK}), 0, {total})) as s)), z ->
      transform(z.f, (m, i) -> struct('{kind}' as kind,
          aggregate(slice(z.s, 1, div_floor(i)), 0, {total})
            + aggregate(slice(z.n, div_floor(i) * {BLOCK} + 1, i % {BLOCK}), 0, {total}) + length(get(z.p, i)) as start,
          aggregate(slice(z.s, 1, div_floor(i)), 0, {total})
            + aggregate(slice(z.n, div_floor(i) * {BLOCK} + 1, i % {BLOCK} + 1), 0, {total}) as stop,
          m as found, right(get(z.p, i), {CONTEXT}) as before, left(get(z.p, i + 1), {CONTEXT}) as after)))[0])[0])[0]
    """.replace("div_floor(size(y.f))", f"cast(floor(size(y.f) / {BLOCK}) as int)") \
       .replace("div_floor(i)", f"cast(floor(i / {BLOCK}) as int)")


DIGITS = "regexp_replace(m.found, '[^0-9]', '')"
# the sum of a card's digits, every second from the right doubled, its digits added up
LUHN = ("aggregate(transform(split(reverse(" + DIGITS + "), ''), (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0))), "
        "0, (a, v) -> a + v) % 10 = 0")
CHECK = {
    "email": "true",
    "ip": "forall(split(m.found, '[.]'), q -> length(ltrim('0', q)) <= 3 and int(concat('0', ltrim('0', q))) <= 255)",
    "card": f"length({DIGITS}) between 12 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 9 and 15",
}
# what a text must hold for a pattern to be worth trying
NEEDS = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0"}
EMPTY = f"cast(array() as array<{SPAN}>)"


def find_spans(docs: DataFrame) -> DataFrame:
    """Add ``base`` (checked spans) and ``more`` (candidates that overlap none of them) to ``docs`` with ``text``."""
    d = docs.withColumn("digits", F.expr("text rlike '[0-9]'"))
    for k in KINDS:
        need = NEEDS.get(k, "digits")
        d = d.withColumn(f"all_{k}", F.expr(f"if({need}, {_place('text', k)}, {EMPTY})"))
    base = F.concat(*[F.expr(f"filter(all_{k}, m -> {CHECK[k]})") for k in BASE])
    d = d.withColumn("base", base)
    # Whether a candidate overlaps a base span.  The outer one-element transform binds both
    # lists once: a column named inside a lambda may be computed anew for every element.
    d = d.withColumn("more", F.expr("""transform(array(struct(base as b, concat(all_number, all_secret) as c)), x ->
        transform(x.c, m -> struct(m.kind as kind, m.start as start, m.stop as stop, m.found as found, m.before as before,
        m.after as after, exists(x.b, o -> o.start < m.stop and m.start < o.stop) as over)))[0]"""))
    return d.drop("digits", *[f"all_{k}" for k in KINDS])


def _side(col: str, last: bool) -> str:
    c = f"right({col}, 1)" if last else f"left({col}, 1)"
    return f"case when {c} = '' or {c} rlike '\\\\s' then 0 when {c} in ('\"', '\\'') then 1 when {c} rlike '[0-9A-Za-z]' then 2 else 3 end"


N_DIGITS = f"length({DIGITS})"
FEATURES = {
    "digits": f"case when {N_DIGITS} < 9 then 0 when {N_DIGITS} < 12 then 1 when {N_DIGITS} < 16 then 2 "
              f"when {N_DIGITS} = 16 then 3 when {N_DIGITS} < 20 then 4 else 5 end",
    "spaces": "least(length(m.found) - length(replace(m.found, ' ', '')), 2)",
    "signs": "least(length(regexp_replace(m.found, '[^().-]', '')), 2)",
    "plus": "int(startswith(m.found, '+'))",
    "before": _side("m.before", True), "after": _side("m.after", False),
    "contact": "int(m.before rlike '" + CONTACT.replace("\\", "\\\\") + "')",
    "letters": "case when m.found rlike '^[0-9]+$' then 0 when m.found rlike '^[0-9a-fA-F]+$' then 1 "
               "when m.found rlike '^[0-9A-Za-z]+$' then 2 else 3 end",
    "cases": "int(m.found rlike '[a-z]') + int(m.found rlike '[A-Z]')",
    "length": "case when length(m.found) < 20 then 0 when length(m.found) < 32 then 1 when length(m.found) < 41 then 2 "
              "when length(m.found) < 65 then 3 else 4 end",
}
def _like(pattern: str) -> str:
    return "m.before rlike '" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


FEATURES["credential"] = f"case when {_like(CREDENTIAL)} then 2 when {_like(CREDENTIAL_WORD)} then 1 else 0 end"
# zero-width places at which a run changes its kind of character
CHANGE = ("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")
LABEL = {"number": f"int(length({DIGITS}) between 12 and 19 and {LUHN})",
         "secret": f"int(regexp_count(m.found, '{CHANGE}') >= {RANDOM} * length(m.found))"}


def counts_by_features(found: DataFrame, kind: str) -> list[tuple[tuple[int, ...], int, int]]:
    """(feature vector, candidates, positives) over all documents; at most the product of the bins."""
    names = list(BINS[kind])
    one = found.select(F.explode(F.expr(f"filter(more, m -> m.kind = '{kind}')")).alias("m")).select(
        *[F.expr(FEATURES[n]).alias(n) for n in names], F.expr(LABEL[kind]).alias("y"))
    rows = one.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    return sorted((tuple(int(r[n]) for n in names), int(r["n"]), int(r["y"])) for r in rows)


def _tree(rows, gradient, hessian, bins):
    """The best depth-two tree on binned features: (feature, cut, feature, cut, four leaf values)."""
    def best(part):
        top = (0.0, None, None)
        g, h = sum(gradient[i] for i in part), sum(hessian[i] for i in part)
        for f, n in enumerate(bins):
            for cut in range(1, n):
                left = [i for i in part if rows[i][0][f] < cut]
                gl, hl = sum(gradient[i] for i in left), sum(hessian[i] for i in left)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > top[0] + 1e-12:
                    top = (gain, f, cut)
        return top

    def value(part):
        return sum(gradient[i] for i in part) / (sum(hessian[i] for i in part) + 1)

    all_ = list(range(len(rows)))
    _, f, cut = best(all_)
    if f is None:
        return ("leaf", value(all_))
    out = []
    for part in ([i for i in all_ if rows[i][0][f] < cut], [i for i in all_ if rows[i][0][f] >= cut]):
        _, f2, cut2 = best(part)
        if f2 is None:
            out.append(("leaf", value(part)))
        else:
            out.append((f2, cut2, ("leaf", value([i for i in part if rows[i][0][f2] < cut2])),
                        ("leaf", value([i for i in part if rows[i][0][f2] >= cut2]))))
    return (f, cut, out[0], out[1])


def _apply(tree, x) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[1]


def boost(rows, bins) -> tuple[list, float]:
    """Boosted trees for counted feature vectors, and the calibrated threshold of their sum."""
    trees: list = []
    score = [0.0] * len(rows)
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        gradient = [y - n * q for (_, n, y), q in zip(rows, p)]
        hessian = [n * q * (1 - q) for (_, n, _), q in zip(rows, p)]
        tree = _tree(rows, gradient, hessian, bins)
        trees.append(tree)
        score = [s + RATE * _apply(tree, r[0]) for s, r in zip(score, rows)]
    return trees, threshold(list(zip(score, rows)))


def threshold(scored, precision: float = PRECISION) -> float:
    """The least score from which the label holds in ``precision`` of the candidates (inf: from none)."""
    best, n, y = math.inf, 0, 0
    ranked = sorted(scored, key=lambda t: -t[0])
    for (s, r), after in zip(ranked, [t[0] for t in ranked[1:]] + [-math.inf]):
        n, y = n + r[1], y + r[2]
        # equal scores pass a threshold together
        if after < s - 2e-9 and y >= precision * n:
            best = s
    return best - 1e-9 if best < math.inf else best


def calibrate(kind: str, rows, trees) -> list[float]:
    """The threshold of each context of a kind."""
    at = list(BINS[kind]).index(CONTEXT_FEATURE[kind])
    out = []
    for context, prior in enumerate(PRIOR[kind]):
        own = [(sum(RATE * _apply(t, r[0]) for t in trees), r) for r in rows if r[0][at] == context]
        out.append(threshold(own, PRECISION / prior) if prior >= PRECISION else math.inf)
    return out


def _sql(tree, names) -> str:
    if tree[0] == "leaf":
        return repr(float(tree[1])) + "D"
    return f"if(({FEATURES[names[tree[0]]]}) < {tree[1]}, {_sql(tree[2], names)}, {_sql(tree[3], names)})"


def _score_sql(kind: str, model) -> str:
    """SQL: whether a candidate ``m`` of the kind reaches its context's threshold."""
    trees, limits = model
    if all(t == math.inf for t in limits):
        return "false"
    names = list(BINS[kind])
    least = " ".join(f"when {c} then {t!r}D" for c, t in enumerate(limits) if t < math.inf)
    # a context without a threshold compares with NULL and accepts nothing
    return ("coalesce((" + " + ".join(f"{RATE}D * {_sql(t, names)}" for t in trees)
            + f") >= case ({FEATURES[CONTEXT_FEATURE[kind]]}) {least} end, false)")


def train(found: DataFrame) -> dict:
    """One model per generator, from the candidates of all documents."""
    out = {}
    for k in ADDED:
        rows = counts_by_features(found, k)
        trees = boost(rows, list(BINS[k].values()))[0] if rows else []
        out[k] = trees, calibrate(k, rows, trees)
    return out


def detect(docs: DataFrame, models: dict | None = None) -> DataFrame:
    """Add ``spans``, all spans by start and kind, and ``base`` to ``docs`` with a column ``text``.

    Without ``models``, they are trained on ``docs`` itself.
    """
    found = find_spans(docs)
    if models is None:
        # candidates alone are kept: documents without any are not
        models = train(kept(found.where("size(more) > 0").select("more")))
    add = "filter(more, m -> not m.over and case m.kind " + " ".join(
        f"when '{k}' then {_score_sql(k, models[k])}" for k in ADDED) + " end)"
    order = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    lean = f"m -> struct(m.start as start, array_position({order}, m.kind) as rank, m.stop as stop, m.kind as kind)"
    return (found.withColumn("added", F.expr(add))
            .withColumn("spans", F.expr(f"array_sort(concat(transform(base, {lean}), transform(added, {lean})))"))
            .withColumn("base", F.expr(f"array_sort(transform(base, {lean}))")).drop("more", "added"))


def joined(col: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.expr(f"concat_ws(',', transform({col}, s -> concat(s.kind, ':', s.start, ':', s.stop)))")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                    F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    d = detect(d)
    return d.select("doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
                    F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets (overlapping spans by the first one's)."""
    cols = docs.columns
    d = detect(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
                           F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    # reach: where the spans before each span end
    cut = """transform(array(struct(text as t, spans as a)), w ->
        transform(array(struct(w.t as t, w.a as a,
            transform(w.a, (s, i) -> coalesce(array_max(transform(slice(w.a, 1, i), o -> o.stop)), 0)) as reach)), x ->
        concat_ws('', transform(x.a, (s, i) -> concat(
            if(s.start > get(x.reach, i), substring(x.t, get(x.reach, i) + 1, s.start - get(x.reach, i)), ''),
            if(s.start >= get(x.reach, i), concat('[', upper(s.kind), ']'), ''))),
            substring(x.t, array_max(transform(x.a, o -> o.stop)) + 1, length(x.t))))[0])[0]"""
    new = F.when(F.size("spans") == 0, F.col("row").getField(text_col)).otherwise(F.expr(cut))
    return d.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in cols])
