"""Operators 11 to 13 against plain re-statements, and their edge cases."""

import gzip
import hashlib
import itertools
import os
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from recframe.llm import conversation_repair, filter_audit, warc  # noqa: E402


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------- op 11
PAGES = "page_id long, url string, html string"


def pages():
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "x" * 100
    return [(1, "http://a.b/c?d#e", "<p>é</p>"), (2, "https://h", ""), (3, None, None), (4, "http://x/\r\nEvil: 1", tricky * 3), (5, "u", tricky * 3),
            (6, "u", "\r\n\r\n" + "z" * 100 + "\r\n\r\n"), (7, "u", long), (-8, "v", long), (9, "w", long), (7, "u", long), (None, "n", long),
            (10, "s", "x" * 99), (11, "s", "x" * 99), (12, "s", "é" * 50), (13, "s", "é" * 50), (None, None, None),
            (14, "big", "line\n" * 200_000), (15, "one line", "y" * 700_000)]


def captures(rows):
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = html or ""
        n = len(data.encode())
        again = n >= 100 and data in first
        out.append((page, n, sha(data), "revisit" if again else "response", first[data] if again else None))
        if n >= 100:
            first.setdefault(data, page)
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    assert rows_of(warc.archive_digest(spark.createDataFrame(pages(), PAGES).repartition(3))) == captures(pages())
    assert warc.archive_digest(spark.createDataFrame([], PAGES)).count() == 0
    odd = spark.createDataFrame(pages()[:3], PAGES).withColumn("uid", F.lit("a")).withColumn("first", F.lit(1)).withColumn("digest", F.lit(2))
    assert rows_of(warc.archive_digest(odd)) == captures(pages()[:3])


def test_transactions(spark, tmp_path):
    """Archives of another writer: one gzip member a record, odd links, a cut end."""
    def record(kind, name, block, *links):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n" + "".join(f"warc-concurrent-to: {x}\r\n" for x in links)
        return (head + f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) + b"\n\n"
    parts = [record("warcinfo", "<i>", b""), record("response", "<r1>", body), record("request", "<q2>", b"", "<r1>"), record("request", "<q1>", b"GET", "<r1>"),
             record("metadata", "<m1>", b"k: v", "<q1>"), record("metadata", "<m2>", b"k: w", "<r1>", "<q3>"), record("request", "<q3>", b"", "<gone>"),
             record("response", "<r2>", b""), record("response", "<r3>", body)[:-30]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:4]) + gzip.compress(b"".join(parts[4:])))
    records = warc.read_archives(spark, str(tmp_path)).cache()
    by = {r.record_id: r for r in records.collect()}
    assert bytes(by["<r1>"].payload) == body[19:] and by["<r1>"].http_head == "HTTP/1.1 200 OK" and by["<r2>"].complete and not by["<r3>"].complete
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    names = lambda rows: [r.record_id for r in rows]
    assert sorted(got) == ["<gone>", "<r1>", "<r2>", "<r3>"]
    assert (names(got["<r1>"].requests), names(got["<r1>"].metadata)) == (["<q1>", "<q2>"], ["<m1>", "<m2>"])
    assert got["<gone>"].response is None and names(got["<gone>"].requests) == ["<q3>"] and names(got["<gone>"].metadata) == ["<m2>"]
    assert got["<r2>"].requests == [] and bytes(got["<r1>"].response.payload) == body[19:]


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_framer_at_any_cut(size):
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nX: %d\r\n\r\n" % (len(b), i) + b + b"\r\n\r\n" for i, b in enumerate([b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n" * 9, b"a" * 200]))
    framer, got = warc.Framer(), []
    for at in range(0, len(data), size):
        got += framer.feed(data[at:at + size])
    got += framer.feed(b"", True)
    assert [(f["x"], b, w) for f, b, w in got] == [(["0"], b"", True), (["1"], b"\r\n\r\n", True), (["2"], b"WARC/1.1\r\n\r\n" * 9, True), (["3"], b"a" * 200, True)]


# ------------------------------------------------------------------------- op 12
def audit(rows, labels):
    import re

    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    fails = []
    for doc, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(w) < 50 else set()
        own |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        own |= {"D"} if re.search("[#$%&*|]", t) else set()
        own |= {"E"} if doc is not None and any(o is not None and o < doc and (x or "") == t for o, x, _ in rows) else set()
        fails.append((source or "", own, doc in good and doc is not None, doc in toxic and doc is not None))
    out, total = [], {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                            sum(d[2] for d in gone), sum(d[3] for d in gone), f))
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def test_filter_interactions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [rng.choice(["lorem", "Ipsum", "é", "DOLOR", "x%d" % i]) + rng.choice(["", "", str(rng.randint(0, 60))]) for _ in range(rng.choice([0, 10, 49, 50, 80, 120]))]
        rows.append((rng.choice([i, i, 100 - i]), rng.choice([" ", "\t\n", "  "]).join(words) + rng.choice(["", "", " #", " 5%"]), rng.choice(["a", "b", "", None])))
    rows += [(200 + i, rows[i % 3][1], "a") for i in range(9)] + [(300, None, "a"), (299, "", "b"), (None, "", None), (None, None, "a"), (300, None, "a"), rows[0], rows[0]]
    rows += [(400, "A" * 30_000 + " b" * 30_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 310, 2)] + [(2, 1, 1), (None, 1, 1), (300, 1, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit(rows, labels)
    assert rows_of(filter_audit.interaction_audit(d, marks)) == sorted(want, key=repr)
    odd = d.withColumn("n", F.lit("a")).withColumn("own", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("quality", F.lit(1))
    assert rows_of(filter_audit.interaction_audit(odd, marks)) == sorted(want, key=repr)
    assert filter_audit.interaction_audit(d.limit(0), marks).count() == 0
    assert filter_audit.interaction_audit(d, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_shapley_weights_are_those_of_the_orders():
    from math import factorial

    for m in (2, 3, 5):
        for i, row in enumerate(filter_audit.shapley_weights(m)):
            for s, w in enumerate(row):
                n = s.bit_count()
                inside = s >> i & 1
                orders = factorial(n - 1) * factorial(m - n) if inside else -factorial(n) * factorial(m - n - 1) if s else 0
                assert w * factorial(m) == (orders if s else 0)  # the empty coalition removes nothing


# ------------------------------------------------------------------------- op 13
TALKS = "conv_id long, turn long, role string, text string"


def repaired(talks, damaged=True):
    """All cheapest edit sequences by depth-first search; the least of them."""
    out = []
    for conv in {r[0] for r in talks}:
        rows = []
        for c, turn, role, text in talks:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            if fate:
                text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
                rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, n = set(), [], dict.fromkeys("bdt", 0)
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            kind = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append(kind)
            if kind:
                n[kind] += 1
        found = []
        goal = lambda roles: roles == "" or (len(s := roles[roles.startswith("s"):]) >= 2 and s == "ua" * (len(s) // 2))

        def follow(state):
            return {"": "su", "s": "u", "u": "a", "a": "u"}[state]

        def moves(i, state):
            yield state, 3, "D"
            if kinds[i] not in ("b", "d"):
                more = kinds[i] == "t"
                for x in follow(state):
                    if rows[i][1][:1] == x:
                        yield x, more, "K"
                    if x != "s":
                        yield x, 2 + more, "R"

        def search(i, state, cost, edits, done):
            if cost > limit or len(done) > 2 * len(rows) + 4:
                return
            if i == len(rows):
                if state in ("", "a") and cost == limit:
                    found.append((edits, done))
            else:
                for s, c, letter in moves(i, state):
                    name = rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}.get(s)
                    search(i + 1, s, cost + c, edits + letter, done if letter == "D" else [*done, f"{name}:{rows[i][2]}"])
            for s in follow(state):
                if s != "s":
                    search(i, s, cost + 2, edits + "I", [*done, {"u": "user:", "a": "assistant:"}[s]])

        for limit in range(4 * len(rows) + 1):
            search(0, "", 0, "", [])
            if found:
                break
        edits, done = min(found)
        turns = [r[0] for r in rows if r[0] is not None]
        assert goal("".join(x[:1] for x in done))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["b"], n["d"], n["t"], illegal, limit, edits, sha("\n".join(done))))
    return sorted(out, key=repr)


def talks():
    rng = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 6)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]),
                         rng.choice(["Yes.", "No!", "so", "é?", " ", "", None, "Yes.\n", "a. b", "x "])))
    return rows + [(500, None, "user", "a."), (500, None, "user", "a."), (None, 1, "user", "q."), (None, None, "assistant", "r."), (None, 2, "assistant", "r.")]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # conversations over many ranges
    try:
        df = spark.createDataFrame(talks(), TALKS).repartition(3)
        assert rows_of(conversation_repair.repair_digest(df)) == repaired(talks())
        assert conversation_repair.repair_digest(df.limit(0)).count() == 0
        odd = df.withColumn("copies", F.lit("a")).withColumn("run", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("stage", F.lit(0))
        assert rows_of(conversation_repair.repair_digest(odd)) == repaired(talks())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repair_of_one_hot_conversation(spark):
    """A long conversation over many ranges, with a message that comes thousands of times."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}.") for i in range(3000)] + [(1, 77, "user", "again.")] * 4000 + [(2, 0, "user", "x" * 300_000)]
    got = {}
    for r in conversation_repair.repair(spark.createDataFrame(rows, TALKS).repartition(5)).collect():
        got.setdefault(r.conv_id, []).append((r.position, r.role, r.edit, len(r.text)))
    mine = [m[1][0] for m in sorted(got[1])]
    assert "".join(mine) == "ua" * (len(mine) // 2) and [m[0] for m in sorted(got[1])] == list(range(len(mine)))
    digest = conversation_repair._repaired(spark.createDataFrame(rows, TALKS), spark.createDataFrame(rows, TALKS), conversation_repair._Digest)
    r = {x.conv_id: x for x in digest.collect()}
    assert r[1].duplicate == 3999 and r[1].truncated == 0 and r[1].gaps == 0 and r[1].audit.count("D") >= 3999
    assert (r[2].cost, r[2].audit) == (3, "D")


def test_every_cut_of_a_span_derives_the_same_cell():
    """The chart (one cut a span) against all cuts of all spans."""
    rng = random.Random(2)
    for _ in range(60):
        cells = [conversation_repair.LEXICON[rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 1, 2])] for _ in range(rng.randint(1, 9))]
        spans = {(i, i + 1): c for i, c in enumerate(cells)}
        for length in range(2, len(cells) + 1):
            for i in range(len(cells) - length + 1):
                cuts = [conversation_repair.combine(spans[i, k], spans[k, i + length]) for k in range(i + 1, i + length)]
                assert all(c == cuts[0] for c in cuts)
                spans[i, i + length] = cuts[0]
        chart = conversation_repair.Chart()
        for c in cells:
            chart.add(c)
        assert chart.cell() == spans[0, len(cells)]
    one = conversation_repair.LEXICON["u", 2]
    chart = conversation_repair.Chart()
    for _ in range(13):
        chart.add(one)
    assert chart.cell() == conversation_repair.repeated(one, 13)
