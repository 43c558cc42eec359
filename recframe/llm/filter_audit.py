"""Operator 12: how five document filters interact, in every order.

Each document fails a set of the filters, a mask of five bits.  Documents are
counted by (part, mask) - 32 numbers a part, all the later work needs - and

* ``v(S)``, the removals of a coalition S of filters, is the number of documents
  whose mask meets S: a table of 32 values a part;
* a filter after the coalition P before it removes ``v(P + f) - v(P)``, keeps
  ``v({}) = 0`` less, and so on: all step counts are differences of coalitions;
* Shapley values solve the weighted least squares
  ``min sum_S w(|S|) (v(S) - sum_{i in S} phi_i)^2`` over the proper coalitions,
  with ``w(s) = (M-1) / (C(M,s) s (M-s))``, under ``sum phi = v(all)``.  The normal
  equations are solved in rationals, with the 32 unit games as right-hand sides:
  the solution is linear in ``v``, so the 5 x 32 solved numbers (fixed by M = 5)
  apply to every part inside Spark.  Over all 120 orders they are whole numbers.

Failures: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z]
> 5 * code points; D any of #$%&*|; E equal to the text of a smaller doc_id.

Data movement: doc_id, digest (SHA-256), part and bits of each document; texts
stay where they are read.  Repeated rows and texts are combined before every
exchange, and a document meets the first of its text by (digest, doc_id), so a
text that a third of all documents share is spread by doc_id.

Defined cases: a null text is empty (fails A, and E if not the first); a null
source is the part ''; a null doc_id is neither smaller nor larger than any
other, so it never fails E; rows of one doc_id and text are equal in E, all or
none of them fail; a doc_id with several labels rows is good or toxic if one
says so, one without has neither; an empty table has no parts; other columns are
ignored.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SIGNS = "[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> Column:
    """Bits of the failures A to D, which a text alone decides."""
    def bits(words: Column) -> Column:
        n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.char_length(text)
        capitals = chars - F.char_length(F.translate(text, _CAPITALS, ""))
        failed = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * chars, text.rlike(SIGNS)]
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))

    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    # one element: the word list is built once and used three times
    return F.transform(F.array(words), bits)[0]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own"))
            .groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n")))
    first = (slim.where("doc_id is not null").groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first_id")))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("is_good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("is_toxic")))
    named = slim.where("doc_id is not null")
    named = (named.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first_id")), "left")
             .join(marks, F.col("doc_id") == F.col("labelled"), "left")
             .select("part", "n", (F.col("own") + F.when(F.col("d").isNull(), F.lit(16)).otherwise(F.lit(0))).alias("mask"),
                     F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic")))
    nameless = slim.where("doc_id is null").select("part", "n", F.col("own").alias("mask"), F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    return (named.unionByName(nameless).groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic")))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix X = right, by exact elimination."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                by = rows[r][k]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(m: int = len(FILTERS)) -> list[list[Fraction]]:
    """Row i: the weight of each coalition's value in the Shapley value of i, from
    the normal equations of the kernel-weighted least squares with the
    efficiency constraint as a Lagrange multiplier."""
    full = (1 << m) - 1
    weight = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in range(1, full)}
    member = lambda s, i: s >> i & 1
    normal = [[sum((w for s, w in weight.items() if member(s, i) and member(s, j)), Fraction(0)) for j in range(m)] for i in range(m)]
    system = [row + [Fraction(1)] for row in normal] + [[Fraction(1)] * m + [Fraction(0)]]
    games = [[weight.get(s, Fraction(0)) * member(s, i) for s in range(full + 1)] for i in range(m)]
    return solve(system, [*games, [Fraction(s == full) for s in range(full + 1)]])[:m]


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: 600 rows a part."""
    orders = factorial(len(FILTERS))
    whole = [[w * orders for w in row] for row in shapley_weights()]
    if any(w.denominator != 1 for row in whole for w in row):
        raise ArithmeticError("the sums over all orders are not whole numbers")

    def removals(count: str) -> Column:
        """v(S) of all coalitions S."""
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(count)).otherwise(F.lit(0))) for s in range(ALL + 1)])

    tables = (failure_counts(docs, labels).groupBy("part")
              .agg(F.sum("n").alias("total"), removals("n").alias("v"), removals("good").alias("v_good"), removals("toxic").alias("v_toxic"))
              .select("*", F.array(*[sum((F.lit(int(w)) * F.col("v")[s] for s, w in enumerate(row) if w), F.lit(0)) for row in whole]).alias("phi")))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(FILTERS[i] for i in order), "k": k + 1, "before": before, "alone": 1 << f, "f": f})
            before |= 1 << f
    each = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,k:int,before:int,alone:int,f:int>>")  # 600 steps, whatever the data
    rows = tables.select("*", F.explode(each).alias("s")).select(
        "*", F.col("s.before").alias("before"), F.col("s.alone").alias("alone"), F.col("s.before").bitwiseOR(F.col("s.alone")).alias("after"))
    gain = lambda v: F.col(v)[F.col("after")] - F.col(v)[F.col("before")]
    return rows.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), (F.col("total") - F.col("v")[F.col("after")]).alias("kept"),
        gain("v").alias("removed"), (F.col("v")[F.col("alone")] - gain("v")).alias("redundant"),
        (F.col("v")[ALL] - F.col("v")[F.lit(ALL) - F.col("alone")]).alias("unique_fails"), gain("v_good").alias("good_lost"),
        gain("v_toxic").alias("toxic_lost"), F.col("phi")[F.col("s.f")].alias("shapley"))


#: The steps one by one from the masks, and Shapley values as sums over the orders.
SQL = f"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
masks as (
  select doc_id, part,
         case when len(w) < {MIN_WORDS} then 1 else 0 end + case when 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) then 2 else 0 end
         + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(t) then 4 else 0 end
         + case when regexp_matches(t, '{SIGNS}') then 8 else 0 end + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
  from words),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
counts as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from masks left join marks using (doc_id) group by part, mask),
f as (select chr(65 + i) as l, 1 << i as b from (select unnest([0, 1, 2, 3, 4]) as i)),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from f a, f b, f c, f d, f e where a.b | b.b | c.b | d.b | e.b = 31),
steps as (
  select filter_order, step, bits[step] as alone, cast(list_sum(list_concat([0], bits[1:step - 1])) as bigint) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
done as (
  select part, filter_order, cast(step as integer) as step, alone,
         sum(case when mask & (before | alone) = 0 then n else 0 end) as kept,
         sum(case when mask & before = 0 and mask & alone <> 0 then n else 0 end) as removed,
         sum(case when mask & before <> 0 and mask & alone <> 0 then n else 0 end) as redundant,
         sum(case when mask = alone then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & alone <> 0 then good else 0 end) as good_lost,
         sum(case when mask & before = 0 and mask & alone <> 0 then toxic else 0 end) as toxic_lost
  from counts, steps group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, alone) as bigint) as shapley
from done
"""
