"""Probabilistic record linkage without listing the pairs of a block.

Records that agree on every linkage field behave alike, so they are one
*class* with a count. The score of a pair depends only on which fields agree,
disagree or are missing. That turns the threshold into a short list of field
sets whose agreement is enough (:func:`sufficient_sets`):

* :func:`scored_pairs` joins classes on those sets, so that only pairs that can
  pass the threshold ever meet;
* :func:`link_edges` needs no pairs at all: everything that agrees on such a set
  is linked to the least id among it;
* :func:`candidate_pair_counts` counts the pairs of the blocking rules from
  group sizes.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.names import name_prefix
from riskloom.operators.components import connected_components
from riskloom.session import cut_lineage, stored

# --- Fixed values: linkage settings ---
FIELDS = ["name_normalized", "zip5", "naics_4digit", "site_state", "address_key"]
BLOCKING_RULES = [("zip5",), ("site_state", "name_prefix"), ("name_prefix", "naics_4digit")]
PRIOR = 1e-5
AGREEMENT_IF_SAME = 0.95
PREDICT_THRESHOLD = 0.80
CLUSTER_THRESHOLD = 0.85
# --- end of fixed values ---

_ALL = frozenset([*FIELDS, "name_prefix"])


def linkage_input(inspections: DataFrame, wages: DataFrame, missing_prefix: str | None = None) -> DataFrame:
    """One record per inspection and wage action with the linkage fields.

    ``missing_prefix`` stands in for a missing industry prefix, so that records without
    one share blocks; by default they share none.
    """
    name = F.col("name_normalized")
    named = name.isNotNull() & (name != "")
    missing = F.lit(None).cast("string")
    osha = inspections.filter(named).select(
        F.col("activity_nr").cast("string").alias("unique_id"), F.lit("OSHA").alias("source"), "name_normalized",
        name_prefix(name).alias("name_prefix"), "zip5", "site_state", "naics_4digit", "address_key",
    )
    whd = wages.filter(named).select(
        F.concat(F.lit("whd_"), F.col("case_id").cast("string")).alias("unique_id"), F.lit("WHD").alias("source"),
        "name_normalized", name_prefix(name).alias("name_prefix"), "zip5", F.col("state").alias("site_state"),
        missing.alias("naics_4digit"), missing.alias("address_key"),
    )
    records = osha.unionByName(whd)
    return records if missing_prefix is None else records.fillna(missing_prefix, ["naics_4digit"])


# --- evidence ---


def chance_agreement(records: DataFrame) -> DataFrame:
    """Per field, the share of record pairs with known values that agree: exact, from value counts."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    counted = (
        records.select(F.explode(entries).alias("e"))
        .select("e.field", "e.value")
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    sums = counted.groupBy("field").agg(F.sum("n").alias("known"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    share = F.coalesce(F.try_divide("same", F.col("known") * (F.col("known") - 1)), F.lit(0.0))
    return sums.select("field", F.col("known").cast("long").alias("known"), share.alias("u"))


class Evidence:
    """Log-odds per field.

    A field that agrees by chance in a share of ``silent_from`` pairs or more says
    nothing. The default is ``m``: from there on agreement would count against a match.
    """

    def __init__(self, u: dict[str, float], m: float = AGREEMENT_IF_SAME, prior: float = PRIOR, silent_from: float | None = None):
        self.prior = math.log2(prior / (1 - prior))
        self.agree, self.differ = {"name_prefix": 0.0}, {"name_prefix": 0.0}
        for field in FIELDS:
            chance = max(u.get(field, 0.0), 1e-12)
            silent = chance >= (m if silent_from is None else silent_from)
            self.agree[field] = 0.0 if silent else math.log2(m / chance)
            self.differ[field] = 0.0 if silent else math.log2((1 - m) / (1 - chance))

    @staticmethod
    def bits(probability: float) -> float:
        return math.log2(probability / (1 - probability))

    def score(self, agree: frozenset[str], differ: frozenset[str] = frozenset()) -> float:
        return self.prior + sum(self.agree[f] for f in sorted(agree)) + sum(self.differ[f] for f in sorted(differ))


def evidence_of(records: DataFrame, m: float = AGREEMENT_IF_SAME, prior: float = PRIOR) -> Evidence:
    """Reads back one number per linkage field."""
    return Evidence({row["field"]: row["u"] for row in chance_agreement(records).collect()}, m, prior)


def _closed(fields: frozenset[str]) -> frozenset[str]:
    """Equal names imply equal name prefixes."""
    return fields | {"name_prefix"} if "name_normalized" in fields else fields


def _blocked(fields: frozenset[str]) -> bool:
    return any(set(rule) <= _closed(fields) for rule in BLOCKING_RULES)


def sufficient_sets(
    evidence: Evidence, threshold: float, known: frozenset[str] = _ALL, others_differ: bool = False
) -> list[frozenset[str]]:
    """Minimal field sets within ``known`` whose agreement puts a pair into a block and over the threshold.

    The remaining known fields count as missing (the best case) or, with
    ``others_differ``, as different (the worst case).
    """
    needed = Evidence.bits(threshold) - 1e-9
    found: list[frozenset[str]] = []
    fields = sorted(known)
    for size in range(1, len(fields) + 1):
        for chosen in map(frozenset, combinations(fields, size)):
            if "name_normalized" in chosen and "name_prefix" in chosen:
                continue
            if any(smaller <= _closed(chosen) for smaller in found) or not _blocked(chosen):
                continue
            differ = (known - _closed(chosen)) if others_differ else frozenset()
            if evidence.score(chosen, differ) >= needed:
                found.append(chosen)
    return found


# --- classes ---


def _signature() -> Column:
    """One hash of all linkage fields that keeps missing apart from ''."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("-")) for f in FIELDS]))


def _mask() -> Column:
    """Bit set of the known fields."""
    bits = [F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)]
    return reduce(lambda a, b: a + b, bits)


def _fields_of(mask: int) -> frozenset[str]:
    """Known fields of a mask. Names are always known in linkage input, and with them prefixes."""
    return _closed(frozenset(f for i, f in enumerate(FIELDS) if mask >> i & 1))


def linkage_classes(records: DataFrame) -> DataFrame:
    """Records that agree on all fields as one row: least id, size, bit set of the known fields."""
    return (
        records.groupBy(*FIELDS, "name_prefix")
        .agg(F.min("unique_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("mask", _mask())
        .withColumn("signature", _signature())
    )


def _key(fields: frozenset[str]) -> Column:
    """Text of the field values; null when one is missing."""
    return F.concat(*[c for f in sorted(fields) for c in (F.col(f), F.lit("\u0001"))])


# --- candidate pairs, counted ---


def candidate_pair_counts(records: DataFrame) -> DataFrame:
    """Pairs per blocking rule, each pair under the first rule that finds it.

    By inclusion and exclusion over group sizes: pairs of rule k less those that
    an earlier rule shares.
    """
    expanded: list[tuple[int, int, frozenset[str]]] = []
    for k, rule in enumerate(BLOCKING_RULES):
        earlier = BLOCKING_RULES[:k]
        for size in range(len(earlier) + 1):
            for subset in combinations(earlier, size):
                fields = frozenset(rule).union(*map(frozenset, subset))
                expanded.append((k + 1, -1 if size % 2 else 1, fields))
    # Records are counted once by all blocking fields; the groups of each term add up these counts.
    fields = sorted(frozenset().union(*[term for _, _, term in expanded]))
    terms = sorted({term for _, _, term in expanded}, key=sorted)
    number = {term: sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in term) for term in terms}  # as grouping_id has it
    counted = records.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupingSets([sorted(term) for term in terms], *fields).agg(
        F.grouping_id().alias("term"), F.sum("n").cast("decimal(38,0)").alias("n")
    )
    whole = [(F.col("term") == number[term]) & reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in sorted(term)]) for term in terms]
    same = groups.filter(reduce(lambda a, b: a | b, whole)).groupBy("term").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    uses = F.array(*[F.struct(F.lit(rule).alias("match_rule"), F.lit(sign).alias("sign"), F.lit(number[term]).alias("term")) for rule, sign, term in expanded])
    signed = same.select("pairs", F.explode(F.filter(uses, lambda use: use["term"] == F.col("term"))).alias("use"))
    return signed.groupBy("use.match_rule").agg((F.sum(F.col("use.sign") * F.col("pairs")) / 2).cast("long").alias("pairs"))


# --- agreement patterns, counted ---


def _pattern_sets() -> list[frozenset[str]]:
    """All sets of agreeing fields that put a pair into a block, closed under equal names."""
    fields = sorted(_ALL)
    chosen = {_closed(frozenset(c)) for size in range(1, len(fields) + 1) for c in combinations(fields, size)}
    return sorted((s for s in chosen if _blocked(s)), key=lambda s: (len(s), sorted(s)))


def pair_patterns(records: DataFrame) -> DataFrame:
    """Record pairs of the blocking rules per pattern of agreement: (gamma_ of each field and of name_prefix, match_rule, pairs).

    1 agree, 0 differ, null when a side is missing; ``match_rule`` is the first rule that
    holds. No pair is listed. Per field set and group of equal values, records are
    counted by which fields they know; products of these counts are the pairs that agree
    at least there, and taking the larger sets away leaves those that agree nowhere else.
    What comes back to the driver is bounded by the fields: sets times pairs of masks.
    """
    # Distinct records are counted by their fields; which masks they have is known beforehand, so one step counts all of a group.
    counted = cut_lineage(linkage_classes(records).select("n", "mask", *FIELDS, "name_prefix"))
    return _patterns(counted)


def _patterns(counted: DataFrame) -> DataFrame:
    """``pair_patterns`` of distinct records, each with its count ``n`` and its mask. They are read twice."""
    sets = _pattern_sets()
    entries = F.array(*[F.struct(F.lit(i).alias("set"), _key(fields).alias("key")) for i, fields in enumerate(sets)])
    masks = sorted(row["mask"] for row in counted.select("mask").distinct().collect())
    classes = counted.select("n", "mask", F.explode(F.filter(entries, lambda e: e["key"].isNotNull())).alias("e"))
    of_mask = [F.sum(F.when(F.col("mask") == mask, F.col("n")).otherwise(0)).alias(f"n_{mask}") for mask in masks]
    groups = classes.groupBy("e.set", "e.key").agg(F.sum("n").alias("total"), *of_mask).filter("total > 1")
    held = [F.struct(F.lit(mask).alias("mask"), F.col(f"n_{mask}").cast("decimal(38,0)").alias("n")) for mask in masks]
    no_mask = F.array().cast("array<struct<mask:int,n:decimal(38,0)>>")
    members = groups.select("set", F.filter(F.array(*held) if held else no_mask, lambda m: m["n"] > 0).alias("m"))
    one = members.select("set", "m", F.explode("m").alias("a"))
    both = one.select("set", "a", F.explode(F.filter("m", lambda b: b["mask"] >= F.col("a.mask"))).alias("b"))
    half = F.col("a.n") * (F.col("a.n") - 1) / 2
    size = F.when(F.col("a.mask") == F.col("b.mask"), half.cast("decimal(38,0)")).otherwise((F.col("a.n") * F.col("b.n")).cast("decimal(38,0)"))
    sums = both.groupBy("set", F.col("a.mask").alias("left"), F.col("b.mask").alias("right")).agg(F.sum(size).alias("pairs")).collect()
    at_least: dict[tuple[int, int], dict[frozenset[str], int]] = {}
    for row in sums:
        at_least.setdefault((row["left"], row["right"]), {})[sets[row["set"]]] = int(row["pairs"])
    totals: dict[tuple, int] = {}
    for (left, right), found in at_least.items():
        known = _fields_of(left) & _fields_of(right)
        exact: dict[frozenset[str], int] = {}
        for agree in sorted(found, key=len, reverse=True):
            exact[agree] = found[agree] - sum(n for larger, n in exact.items() if agree < larger)
            gammas = [1 if f in agree else 0 if f in known else None for f in [*FIELDS, "name_prefix"]]
            rule = next(k for k, fields in enumerate(BLOCKING_RULES, start=1) if set(fields) <= agree)
            totals[*gammas, rule] = totals.get((*gammas, rule), 0) + exact[agree]
    schema = ", ".join(f"gamma_{f} int" for f in [*FIELDS, "name_prefix"]) + ", match_rule int, pairs long"
    return counted.sparkSession.createDataFrame([(*key, n) for key, n in sorted(totals.items(), key=str) if n], schema)


def m_values(records: DataFrame, rounds: int = 5, start: float = AGREEMENT_IF_SAME, prior: float = 0.01) -> DataFrame:
    """(match_rule, field, m): how often fields agree in true matches, learnt by expectation-maximisation.

    Each blocking rule is a session of its own over the pairs that it finds; fields that
    the rule itself makes agree say nothing there and are left out. The chances of
    agreement by accident stay as counted, the share of matches starts at ``prior``. The
    steps run on the patterns of ``pair_patterns`` and their counts, never on pairs.
    Scoring keeps the named constant unless such values are passed on.
    """
    u = {row["field"]: min(max(row["u"], 1e-12), 1 - 1e-12) for row in chance_agreement(records).collect()}
    patterns = pair_patterns(records).collect()
    out = []
    for number, fields in enumerate(BLOCKING_RULES, start=1):
        # Names that are equal have equal prefixes, but not the other way round, so the name itself is learnt.
        learnt = [f for f in FIELDS if f not in fields and f in u]
        rows = [(r["pairs"], {f: r[f"gamma_{f}"] for f in learnt}) for r in patterns if all(r[f"gamma_{f}"] == 1 for f in fields)]
        m, share = dict.fromkeys(learnt, start), prior
        for _ in range(rounds if rows else 0):
            weights = []
            for _, gamma in rows:
                match, accident = share, 1 - share
                for f, g in gamma.items():
                    if g is not None:
                        match, accident = match * (m[f] if g else 1 - m[f]), accident * (u[f] if g else 1 - u[f])
                weights.append(match / (match + accident))
            share = sum(w * n for w, (n, _) in zip(weights, rows)) / sum(n for n, _ in rows)
            for f in learnt:
                told = [(w * n, gamma[f]) for w, (n, gamma) in zip(weights, rows) if gamma[f] is not None]
                if sum(x for x, _ in told) > 0:
                    m[f] = min(max(sum(x for x, g in told if g) / sum(x for x, _ in told), 1e-6), 1 - 1e-6)
        out += [(number, f, m[f]) for f in learnt]
    return records.sparkSession.createDataFrame(out, "match_rule int, field string, m double")


# --- scored pairs ---


def _agreement(field: str) -> Column:
    """1 agree, 0 differ, null when either side is missing."""
    return (F.col(f"l.{field}") == F.col(f"r.{field}")).cast("int")


def compare(pairs: DataFrame, evidence: Evidence) -> DataFrame:
    """Comparison vector and match probability of joined rows aliased ``l`` and ``r``."""
    gammas = {f: _agreement(f) for f in FIELDS}
    bits = F.lit(evidence.prior)
    for f, gamma in gammas.items():
        bits = bits + F.when(gamma == 1, evidence.agree[f]).when(gamma == 0, evidence.differ[f]).otherwise(0.0)
    rule = F.lit(None).cast("int")
    for k, fields in reversed(list(enumerate(BLOCKING_RULES, start=1))):
        same = reduce(lambda a, b: a & b, [F.col(f"l.{f}") == F.col(f"r.{f}") for f in fields])
        rule = F.when(same, k).otherwise(rule)
    return pairs.select(
        "*",
        *[gamma.alias(f"gamma_{f}") for f, gamma in gammas.items()],
        rule.alias("match_rule"),
        (F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), -bits))).alias("match_probability"),
    )


def _pairs_on(classes: DataFrame, rules: list[frozenset[str]], rows_per_cell: int) -> DataFrame:
    """Pairs (l, r) of classes that agree on the fields of a rule, once per such rule, l.rep < r.rep.

    A key that many classes share is cut into cells, so no task joins a whole group.
    """
    keyed = classes.withColumn(
        "e",
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(i).alias("rule"), _key(fields).alias("key")) for i, fields in enumerate(rules)]),
                lambda e: e["key"].isNotNull(),
            )
        ),
    ).select("rep", "n", *FIELDS, "name_prefix", "e.rule", "e.key")
    sizes = keyed.groupBy("rule", "key").agg(F.ceil(F.count(F.lit(1)) / rows_per_cell).alias("cuts"))
    celled = (
        keyed.join(sizes, ["rule", "key"])
        .withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        .withColumn("low", F.least("cut", "other"))
        .withColumn("high", F.greatest("cut", "other"))
        .drop("cuts", "other")
    )
    l, r = celled.alias("l"), celled.alias("r")
    on_key = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("rule", "key", "low", "high")])
    own_cell = (F.least("l.cut", "r.cut") == F.col("l.low")) & (F.greatest("l.cut", "r.cut") == F.col("l.high"))
    return l.join(r, on_key & own_cell & (F.col("l.rep") < F.col("r.rep")))


def _twins(classes: DataFrame) -> DataFrame:
    """Classes of several records, each as a pair (l, r) with itself."""
    itself = F.struct(*classes.columns)
    return classes.filter(F.col("n") > 1).select(itself.alias("l"), itself.alias("r"))


def _scored(pairs: DataFrame, evidence: Evidence) -> DataFrame:
    same_class = F.col("l.rep") == F.col("r.rep")
    size = F.when(same_class, F.col("l.n") * (F.col("l.n") - 1) / 2).otherwise(F.col("l.n") * F.col("r.n")).cast("long")
    return compare(pairs, evidence).select(
        F.col("l.rep").alias("rep_l"), F.col("r.rep").alias("rep_r"), size.alias("pairs"),
        *[f"gamma_{f}" for f in FIELDS], "match_rule", "match_probability",
    )


def scored_pairs(
    records: DataFrame,
    threshold: float = PREDICT_THRESHOLD,
    evidence: Evidence | None = None,
    rows_per_cell: int = 2000,
) -> DataFrame:
    """Pairs of linkage classes with match probability at or above the threshold.

    A row stands for ``pairs`` record pairs: every record of one class with every
    record of the other, or all pairs within a class (``rep_l`` = ``rep_r``).
    """
    evidence = evidence or evidence_of(records)
    classes = linkage_classes(records)
    rules = sufficient_sets(evidence, threshold)
    if not rules:
        rules = [_ALL]
    # The pair is taken under the first rule whose fields all agree.
    first_rule = F.lit(None).cast("int")
    for i, fields in reversed(list(enumerate(rules))):
        agree = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"l.{f}") == F.col(f"r.{f}"), F.lit(False)) for f in sorted(fields)])
        first_rule = F.when(agree, i).otherwise(first_rule)
    between = _pairs_on(classes, rules, rows_per_cell).filter(first_rule == F.col("l.rule"))
    scored = _scored(between, evidence).unionByName(_scored(_twins(classes), evidence))
    passed = F.col("match_probability") >= threshold - 1e-12
    return scored.filter(F.col("match_rule").isNotNull() & passed)


def uncertain_pairs(
    records: DataFrame, k: int = 500, evidence: Evidence | None = None, rows_per_cell: int = 2000, classes: DataFrame | None = None
) -> DataFrame:
    """The pairs of ``scored_pairs`` that ``review_queue`` may choose from, without listing the others.

    Pairs of classes are counted per pattern of agreement first. Patterns between the two
    thresholds are then opened from the least certain on, until they hold ``k`` pairs
    (patterns of one score together), and only pairs of these patterns are listed.
    ``classes`` are those of the records, where they are written already.
    """
    evidence = evidence or evidence_of(records)
    fields = [*FIELDS, "name_prefix"]
    one = F.lit(1).cast("long").alias("n")  # classes are distinct, and their pairs are counted here
    if classes is None:
        classes = linkage_classes(records)
        counted = cut_lineage(classes.select(one, "mask", *fields))
    else:
        counted = classes.select(one, "mask", *fields)
    found = []
    for row in _patterns(counted).collect():
        gammas = {f: row[f"gamma_{f}"] for f in fields}
        agree = frozenset(f for f in fields if gammas[f] == 1)
        score = evidence.score(agree, frozenset(f for f in fields if gammas[f] == 0))
        if Evidence.bits(PREDICT_THRESHOLD) - 1e-9 <= score < Evidence.bits(CLUSTER_THRESHOLD) + 1e-9:
            found.append((score, row["pairs"], agree, gammas))
    found.sort(key=lambda pattern: pattern[0])
    opened, held, last = [], 0, None
    for score, pairs, agree, gammas in found:
        if held >= k and score > last + 1e-9:
            break
        opened.append((agree, gammas))
        held, last = held + pairs, score
    rules = sorted({agree for agree, _ in opened}, key=sorted) or [_ALL]
    wanted = F.lit(False)
    for agree, gammas in opened:
        same = [(F.col(f"l.{f}") == F.col(f"r.{f}")).eqNullSafe(F.lit(gammas[f]).cast("boolean")) for f in fields]
        wanted |= reduce(lambda a, b: a & b, [F.col("l.rule") == rules.index(agree), *same])
    between = _pairs_on(classes, rules, rows_per_cell).filter(wanted)
    scored = _scored(between, evidence).unionByName(_scored(_twins(classes), evidence))
    return scored.filter(F.col("match_rule").isNotNull())


def review_queue(pairs: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` least certain class pairs below the clustering threshold.

    One row asks about all record pairs it stands for: they cannot differ in any compared field.
    """
    p = F.col("match_probability")
    uncertain = pairs.filter((p >= PREDICT_THRESHOLD) & (p < CLUSTER_THRESHOLD))
    return uncertain.orderBy("match_probability", "rep_l", "rep_r").limit(k).select(
        F.col("rep_l").alias("record_id_left"), F.col("rep_r").alias("record_id_right"), "pairs", "match_probability"
    )


# --- clusters ---


def link_keys(classes: DataFrame, evidence: Evidence, threshold: float, *columns: str) -> DataFrame:
    """(*columns, rule, key, side, crosses): the key groups that each class belongs to.

    Sets that suffice even if all other fields differ need no more than equal
    values. Sets that suffice only where other fields are missing are tried per
    pair of known-field masks (at most 136): a class is then linked to classes of
    the *other* mask, told by the side.
    """
    always = sufficient_sets(evidence, threshold, others_differ=True)
    rules: list[tuple[frozenset[str], int | None, int | None]] = [(fields, None, None) for fields in always]
    masks = sorted(row["mask"] for row in classes.select("mask").distinct().collect())
    for i, a in enumerate(masks):
        for b in masks[i:]:
            known = _fields_of(a) & _fields_of(b)
            for fields in sufficient_sets(evidence, threshold, known, others_differ=True):
                if not any(base <= _closed(fields) for base in always):
                    rules.append((fields, a, b))
    if not rules:
        rules = [(_ALL, None, None)]

    mask = F.col("mask")
    entries = []
    for i, (fields, a, b) in enumerate(rules):
        applies = F.lit(True) if a is None else mask.isin(a, b)
        side = F.lit(0) if a is None or a == b else F.when(mask == a, 0).otherwise(1)
        key = F.when(applies, F.unhex(F.md5(_key(fields))))  # 16 bytes, however long the values
        entries.append(
            F.struct(F.lit(i).alias("rule"), key.alias("key"), side.alias("side"), F.lit(a is not None and a != b).alias("crosses"))
        )
    return classes.select(
        *columns, F.explode(F.filter(F.array(*entries), lambda e: e["key"].isNotNull())).alias("e")
    ).select(*columns, "e.rule", "e.key", "e.side", "e.crosses")


def star_edges(keyed: DataFrame, node: str, touched: str | None = None) -> DataFrame:
    """Edges (node, hub) that connect what the key groups link: each node with the least of its group, or of the group's other side.

    With ``touched``, only of groups where this column holds for a member. Groups of one member link nothing.
    Neither side is broadcast, however short its files are: a class has a row for each of its keys.
    """
    wanted = F.count(F.lit(1)) > 1
    if touched:
        wanted &= F.bool_or(touched)
    hubs = keyed.groupBy("rule", "key").agg(
        F.min(F.when(F.col("side") == 0, F.col(node))).alias("hub_0"),
        F.min(F.when(F.col("side") == 1, F.col(node))).alias("hub_1"),
        wanted.alias("wanted"),
    ).filter("wanted").drop("wanted")
    hub = F.when(F.col("crosses") & (F.col("side") == 0), F.col("hub_1")).otherwise(F.col("hub_0"))
    linked = keyed.join(hubs.hint("merge"), ["rule", "key"]).select(node, hub.alias("hub"))
    return linked.filter(F.col("hub").isNotNull() & (F.col(node) != F.col("hub"))).distinct()


def link_edges(classes: DataFrame, evidence: Evidence, threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """Edges (rep, hub) that connect exactly the classes joined by pairs over the threshold."""
    return star_edges(link_keys(classes, evidence, threshold, "rep"), "rep")


def cluster_records(
    records: DataFrame, threshold: float = CLUSTER_THRESHOLD, evidence: Evidence | None = None
) -> DataFrame:
    """(unique_id, cluster_id): connected records share the least id of them; others stand alone.

    Classes are stored once with a number, by which they are linked: numbers are shorter than ids,
    and their minima need no sorting. Classes of one id, should ids repeat, are linked as well.
    """
    evidence = evidence or evidence_of(records)
    number = F.when(F.col("rep").isNotNull(), F.monotonically_increasing_id())
    classes = stored(linkage_classes(records).select("rep", "mask", *FIELDS, "name_prefix", number.alias("at")), "linkage-classes")
    shared = classes.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("at").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = classes.join(stored(shared.select("rep", "hub"), "repeated-ids"), "rep").filter("at != hub").select("at", "hub")
    edges = star_edges(link_keys(classes, evidence, threshold, "at"), "at").unionByName(twice)
    component = connected_components(edges, "at", "hub").withColumnRenamed("node", "at")
    member = classes.join(component, "at", "left").select(_signature().alias("signature"), "rep", F.coalesce("component", "at").alias("component"))
    heads = member.groupBy("component").agg(F.min("rep").alias("head"))
    labelled = member.join(heads, "component", "left").select("signature", F.coalesce("head", "rep").alias("class_cluster"))
    return records_in_classes(records, labelled, evidence, threshold)


def records_in_classes(records: DataFrame, labelled: DataFrame, evidence: Evidence, threshold: float) -> DataFrame:
    """(unique_id, cluster_id) from (signature, class_cluster); records of a class stay apart if its common fields do not suffice.

    Neither side is broadcast: Spark guesses records from files that compress well, and each gets an id and a hash.
    Signatures meet as 16 bytes.
    """
    labelled = labelled.select(F.unhex("signature").alias("signature"), "class_cluster")
    masks = [1 << i for i in range(len(FIELDS))]
    coherent = [
        mask
        for mask in range(1, sum(masks) + 1)
        if _blocked(_fields_of(mask)) and evidence.score(_fields_of(mask)) >= Evidence.bits(threshold) - 1e-9
    ]
    holds = _mask().isin(coherent) if coherent else F.lit(False)
    return (
        records.select("unique_id", F.unhex(_signature()).alias("signature"), holds.alias("holds"))
        .join(labelled.hint("merge"), "signature")
        .select("unique_id", F.when(F.col("holds"), F.col("class_cluster")).otherwise(F.col("unique_id")).alias("cluster_id"))
    )


def merge_same_names(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """Clusters with the same dominant name join the largest of them. Records are not broadcast, however short their files are."""
    names = (
        clusters.join(records.select("unique_id", "name_normalized").hint("merge"), "unique_id")
        .groupBy("cluster_id", "name_normalized")
        .agg(F.count(F.lit(1)).alias("members"))
    )
    dominant = names.groupBy("cluster_id").agg(
        F.min_by("name_normalized", F.struct(-F.col("members"), F.col("name_normalized"))).alias("name_normalized"),
        F.sum("members").alias("total"),
    )
    winners = dominant.groupBy("name_normalized").agg(
        F.min_by("cluster_id", F.struct(-F.col("total"), F.col("cluster_id"))).alias("winner")
    )
    moves = dominant.join(winners, "name_normalized").select("cluster_id", "winner")
    return clusters.join(moves, "cluster_id", "left").select(
        "unique_id", F.coalesce("winner", "cluster_id").alias("cluster_id")
    )


# --- evaluation ---


def precision_recall(pairs: DataFrame, labels: DataFrame, threshold: float = CLUSTER_THRESHOLD, min_labels: int = 50) -> DataFrame:
    """Precision and recall of predicted record pairs against reviewed ones; pair order does not matter.

    ``pairs`` holds (record_id_left, record_id_right, match_probability).
    """
    ordered = [
        F.least("record_id_left", "record_id_right").alias("a"), F.greatest("record_id_left", "record_id_right").alias("b")
    ]
    predicted = pairs.filter(F.col("match_probability") >= threshold).select(*ordered).distinct()
    reviewed = labels.filter(F.col("decision").isNotNull())
    judged = (
        reviewed.select(*ordered, "decision")
        .distinct()
        .join(predicted.withColumn("predicted", F.lit(True)), ["a", "b"], "left")
        .agg(
            F.count_if(F.col("predicted") & (F.col("decision") == "match")).alias("tp"),
            F.count_if(F.col("predicted") & (F.col("decision") == "non_match")).alias("fp"),
            F.count_if(F.col("predicted").isNull() & (F.col("decision") == "match")).alias("fn"),
        )
        .withColumn("labelled_pairs", reviewed.agg(F.count(F.lit(1))).scalar())
    )
    rate = lambda other: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(other)), F.lit(0.0))
    return (
        judged.withColumn("precision", rate("fp"))
        .withColumn("recall", rate("fn"))
        .withColumn("enough_labels", F.col("labelled_pairs") >= min_labels)
        .withColumn("alert", F.col("enough_labels") & ((F.col("precision") < 0.85) | (F.col("recall") < 0.80)))
    )


def same_cluster_pairs(labels: DataFrame, records: DataFrame, evidence: Evidence) -> DataFrame:
    """Match probability of the labelled pairs only: two key joins, no blocking needed."""
    fields = records.select("unique_id", "name_prefix", *FIELDS)
    joined = (
        labels.select("record_id_left", "record_id_right").distinct().alias("p")
        .join(fields.alias("l"), F.col("p.record_id_left") == F.col("l.unique_id"))
        .join(fields.alias("r"), F.col("p.record_id_right") == F.col("r.unique_id"))
        .filter(F.col("l.unique_id") != F.col("r.unique_id"))
    )
    scored = compare(joined, evidence).filter(F.col("match_rule").isNotNull())
    return scored.select("record_id_left", "record_id_right", "match_probability")
