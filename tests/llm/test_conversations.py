"""Chat formatting, conversation repair and whitening against plain versions: SQL, enumeration and numpy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valuegate.llm import conversations
from valuegate.llm import op11_chat_formatting as chat
from valuegate.llm import op12_embedding_whitening as white
from valuegate.llm import op13_conversation_repair as fix

ROWS = "conv_id long, turn long, role string, text string, part string, n_turns long"
NASTY = ["", None, "\\", "\\\\", "<turn>", "</turn>", "<\\turn>", "a<text>\\", "<turn", "</turn></turn>", "<|im_end|>é", "日本 <\\\\text>", "🙂\\<turn>🙂", "\n", "text>", "x" * 300_000 + "\\<turn>" * 2000]


@pytest.fixture
def apart(spark):
    """Partitions as they are dealt, so that conversations cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def talk(seed=5, many=60, hot=300):
    """Rows with odd texts, null values in every column, repeated rows, and one conversation of a third of the rows."""
    rng, rows = random.Random(seed), []
    words = ["yes", "Yes.", "what?", "go on", " ", "\t", "no!", "end.\n", "é", None, "more. ", ""]
    for conv in [*range(many), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u\n"]), rng.choice(words + NASTY[:-1]), "p", 1))
    rows += [(1000, turn, rng.choice(["user", "assistant", "system", "x"]), rng.choice(words + ["one %d." % rng.randint(0, 60)]), "p", 1) for turn in range(hot)]
    rows += rows[:5] + [(2000, 0, "assistant", NASTY[-1], None, None), (2000, 1, "assistant", "after.", None, None)]
    return rows


# Chat formatting


def test_escapes_are_reversible_and_leave_no_control_string():
    roles, texts = pa.array(["user"] * len(NASTY)), pa.array(NASTY)
    buffer, bounds, low, high = chat.assemble(roles, texts, chat.DEFAULT)
    whole = buffer.to_pybytes()
    for k, text in enumerate(NASTY):
        inside = whole[low[k] : high[k]]
        assert not any(m in inside for m in chat.DEFAULT.marks)
        assert re.sub(rb"\\(.)", rb"\1", inside, flags=re.S).decode() == (text or "")
    formatted = pa.array([whole[a:b].decode() for a, b in zip(bounds, bounds[1:])])
    count, role, text = chat.parse(formatted, chat.DEFAULT)
    assert count.tolist() == list(range(len(NASTY) + 1))
    assert [bytes(text[0][a:b]).decode() for a, b in zip(text[1], text[1][1:])] == [t or "" for t in NASTY]
    assert set(bytes(role[0][a:b]) for a, b in zip(role[1], role[1][1:])) == {b"user"}


@pytest.mark.parametrize("stride", [1, 3, 64])
def test_strides_do_not_matter(monkeypatch, stride):
    texts = pa.array(NASTY[:-1] * 2)
    want = chat.assemble(texts, texts, chat.DEFAULT)[0].to_pybytes()
    monkeypatch.setattr(chat, "STRIDE", stride)
    buffer, bounds, *_ = chat.assemble(texts, texts, chat.DEFAULT)
    assert buffer.to_pybytes() == want
    count, role, text = chat.parse(pa.array([want.decode()]), chat.DEFAULT)
    assert count.tolist() == [0, len(texts)] and bytes(role[0]) == bytes(text[0]) == "".join(t or "" for t in texts.to_pylist()).encode()


def test_templates_are_checked():
    for bad in ({"begin": "<a<"}, {"end": "turn"}, {"controls": ("<\\x",)}, {"controls": ("<turn>s",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return con.execute(chat.ORACLE_SQL)


def test_formatting_matches_sql_over_odd_rows(spark, apart):
    rows = talk()
    given = spark.createDataFrame(rows, ROWS)
    planted = spark.createDataFrame([(*r, None, None) for r in chat.PLANTED], ROWS)
    formatted = chat.format_conversations(given.unionByName(planted))
    cut = formatted.groupBy("conv_id").count().filter("count > 1").count()
    assert cut >= 2  # some conversations cross partitions
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    cursor = by_sql(rows)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert len(want) == len(got)
    for values in want:
        row = dict(zip(names, values))
        assert {k: got[row["conv_id"]][k] for k in names} == row


def test_turns_and_trained_spans_read_back(spark, apart):
    rows = talk(9)
    formatted = chat.format_conversations(spark.createDataFrame(rows, ROWS))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    want = defaultdict(list)
    for r in sorted(rows, key=order):
        want[r[0]].append((r[1], r[2] or "", r[3] or ""))
    got, under = defaultdict(list), defaultdict(list)
    for r in sorted(chat.read_turns(formatted).collect(), key=lambda r: (r["part"], r["place"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    for r in sorted(formatted.collect(), key=lambda r: r["part"]):
        under[r["conv_id"]] += [re.sub(r"\\(.)", r"\1", r["formatted"][s["start"] : s["end"]], flags=re.S) for s in r["loss"]]
    assert got.keys() == want.keys()
    for conv, turns in got.items():
        assert sorted(turns) == sorted((r, t) for _, r, t in want[conv])
        assert [r for r, _ in turns] == [r for _, r, _ in want[conv]]
        assert under[conv] == [t for r, t in turns if r == "assistant"]


def test_formatting_of_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert chat.digests(chat.format_conversations(empty)).count() == 0
    assert chat.read_turns(chat.format_conversations(empty)).count() == 0


def test_the_formatting_query_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = con.execute(chat.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    got = chat.query(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_runs_close_long_conversations(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(conversations, "TaskContext", Task)
    monkeypatch.setattr(conversations, "PART_ROWS", 4)
    ids = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, None, 5]
    batches = [pa.RecordBatch.from_pylist([{"conv_id": i} for i in ids[a : a + 5]], schema=pa.schema([("conv_id", pa.int64())])) for a in range(0, len(ids), 5)]
    got = [(rows.column("conv_id")[s].as_py(), e - s, part, whole) for rows, starts, parts, wholes in conversations.runs(iter(batches)) for s, e, part, whole in zip(starts, starts[1:], parts.tolist(), wholes.tolist())]
    assert [(c, n) for c, n, _, _ in got if c != 3] == [(1, 2), (2, 1), (4, 1), (None, 1), (5, 1)]
    assert sum(n for c, n, _, _ in got if c == 3) == 9 and len([c for c, *_ in got if c == 3]) > 1
    parts = [p for *_, p, _ in got]
    assert parts == sorted(set(parts)) and parts[0] == 3 << 32
    whole = {c: w for c, _, _, w in got}
    assert not whole[1] and not whole[5] and not whole[3] and whole[2] and whole[None]


# Conversation repair

LANGUAGE = re.compile(r"(s?(ua)+)?\Z")
STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def enumerated(kinds):
    """The least (cost, audit) of all edits: every choice for every row with up to two inserted rows before it."""
    best = (math.inf, "")

    def from_row(i, roles, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        for put in ("", "u", "a", "ua", "au"):
            here, paid, edits = roles + put, cost + 3 * len(put), audit + "I" * len(put)
            if i == len(kinds):
                if LANGUAGE.match(here):
                    best = min(best, (paid, edits))
                continue
            extra = 3 if kinds[i].isupper() else 0
            from_row(i + 1, here, paid + 4, edits + "D")
            if kinds[i] != "x":
                from_row(i + 1, here + kinds[i].lower(), paid + extra, edits + "K")
                for role in "ua":
                    from_row(i + 1, here + role, paid + 3 + extra, edits + "R")

    from_row(0, "", 0, "")
    return best


def test_audits_are_the_least_of_all():
    rng = random.Random(2)
    cases = [c for n in range(4) for c in itertools.product(fix.KINDS, repeat=n)]
    for kinds in map("".join, rng.sample(cases, 300) + [[rng.choice(fix.KINDS) for _ in range(4)] for _ in range(25)]):
        audit = fix.audit_of(kinds)
        assert (fix.audit_cost(audit, kinds), audit) == enumerated(kinds)


def stepped(kinds):
    """The same by one pass backward and one forward that takes the least letter of all optimal ones."""
    cost = [dict.fromkeys(STATES, math.inf) for _ in range(len(kinds) + 1)]
    put = lambda s: "a" if s == "u" else "u"
    for i in range(len(kinds), -1, -1):
        here = cost[i]
        if i == len(kinds):
            here[""] = here["a"] = 0
        else:
            extra = 3 if kinds[i].isupper() else 0
            for s in STATES:
                ways = [4 + cost[i + 1][s]]
                if kinds[i] != "x":
                    ways += [3 + extra + cost[i + 1][put(s)]] + ([extra + cost[i + 1][kinds[i].lower()]] if kinds[i].lower() in STATES[s] else [])
                here[s] = min(ways)
        for _ in range(3):
            for s in STATES:
                here[s] = min(here[s], 3 + here[put(s)])
    i, s, audit = 0, "", ""
    while i < len(kinds) or s not in ("", "a"):
        extra, ways = 3 if i < len(kinds) and kinds[i].isupper() else 0, []
        if i < len(kinds):
            ways.append(("D", 4 + cost[i + 1][s], i + 1, s))
            if kinds[i] != "x":
                ways.append(("R", 3 + extra + cost[i + 1][put(s)], i + 1, put(s)))
                if kinds[i].lower() in STATES[s]:
                    ways.append(("K", extra + cost[i + 1][kinds[i].lower()], i + 1, kinds[i].lower()))
        ways.append(("I", 3 + cost[i][put(s)], i, put(s)))
        letter, _, i, s = min(w for w in ways if w[1] == cost[i][s])
        audit += letter
    return cost[0][""], audit


def test_long_audits():
    rng = random.Random(3)
    for n in (0, 1, 7, 50, 700):
        kinds = "".join(rng.choice(fix.KINDS) for _ in range(n))
        audit = fix.audit_of(kinds)
        assert (fix.audit_cost(audit, kinds), audit) == stepped(kinds)


def plain_repair(rows):
    """Damage and repair of rows (conv_id, turn, role, text) by the words of the task."""
    space = lambda v: " " if v is None else str(v)
    convs = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        convs[conv].append((turn, space(role), space(text)))
    out = {}
    for conv, given in convs.items():
        made = []
        for turn, role, text in given:
            what = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(what, text)
            role = "user" if what == 4 else role
            made += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        out[conv] = made
    return out


def described(made):
    kinds, seen, counts = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in made:
        left = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    turns = [t for t, _, _ in made if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:]))
    cost, audit = stepped(kinds)
    lines, state, k = [], "", 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role = made[k][1] if edit == "K" else "assistant" if state == "u" else "user"
        lines.append(f"{role}:{'' if edit == 'I' else made[k][2]}")
        state, k = role[:1], k + (edit != "I")
    return counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def same_turn_free(rows):
    """Rows of one turn have no order of their own: keep one of each (conversation, turn)."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_repair_matches_the_plain_version(spark, apart):
    rows = same_turn_free(talk(21, 80, 400))
    got = {r["conv_id"]: r.asDict() for r in fix.digests(fix.repair(fix.damaged(spark.createDataFrame(rows, ROWS)))).collect()}
    want = {conv: described(made) for conv, made in plain_repair(rows).items()}
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert {k: got[conv][k] for k in row} == row, conv
    assert any(not r["whole"] for r in fix.repair(fix.damaged(spark.createDataFrame(rows, ROWS))).select("whole").collect())


def test_rows_of_one_turn_and_repeated_rows_have_one_result(spark, apart):
    rows = talk(4, 20, 90)
    first, again = (sorted(map(tuple, fix.digests(fix.repair(fix.damaged(spark.createDataFrame(r, ROWS)))).collect()), key=repr) for r in (rows, rows[::-1]))
    assert first == again and len(first) == len({r[0] for r in rows})


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert fix.digests(fix.repair(fix.damaged(empty))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = fix.digests(fix.repair(fix.damaged(spark.createDataFrame([(gone, 0, "user", "a.", "", 1)], ROWS)))).first().asDict()
    assert row == dict.fromkeys(fix.COUNTS, 0) | {"conv_id": gone, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_the_repair_query_matches_the_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in fix.query(spark, sf_dir).collect()}
    want = {conv: described(made) for conv, made in plain_repair(rows).items()}
    assert got.keys() == want.keys() and all({k: got[c][k] for k in row} == row for c, row in want.items())


# Whitening

VECTORS = "vec_id long, embedding array<float>, n string, x int"


@pytest.mark.parametrize("values", [np.arange(1, 31.0), np.ones(30), np.r_[3 * np.ones(5), np.linspace(1, 2, 25)], np.r_[5 + 1e-9 * np.arange(5), np.linspace(1, 2, 25)], np.r_[np.zeros(9), np.linspace(1, 1e6, 21)], 5 + 1e-7 * np.arange(30)])
def test_eigenvectors_to_double_precision(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(30, 30)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = white.eigen(a)
    wide = x.astype(np.longdouble)
    assert (np.diff(e) <= 0).all() and np.abs(e - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-14 * np.abs(values).max()
    assert np.abs(wide.T @ wide - np.eye(30)).max() <= 4e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * e).max() <= 4e-16 * np.abs(values).max()


def whitened_plainly(vectors):
    x = np.floor(256 * np.array(vectors, float))
    fit = np.unique(x, axis=0)
    values, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, q = values[::-1], q[:, ::-1]
    k = min(4, x.shape[1])
    return len(fit), fit.sum(axis=0), (x - fit.mean(axis=0)) @ q[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), x


def compare(rows, ids, vectors):
    n, sums, whitened, explained, x = whitened_plainly(vectors)
    k = whitened.shape[1]
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    order = np.argsort(ids, kind="stable")
    assert [r["vec_id"] for r in rows] == [ids[i] for i in order for _ in range(k)] and {r["n"] for r in rows} == {n}
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    assert np.abs(got * np.sign((got * whitened[order]).sum(axis=0)) - whitened[order]).max() < 1e-9
    assert [r["deviation"] for r in rows[::k]] == ((n * x - sums) ** 2).sum(axis=1)[order].astype(int).tolist()
    assert np.abs(np.array([r["explained"] for r in rows[:k]]) - explained).max() < 1e-12 and rows[0]["identity_error"] < 1e-10


def test_whitening_matches_numpy(spark, apart):
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(400, 6)) * [1, 2, 3, 4, 5, 6]).astype(np.float32)
    made = np.concatenate((made, np.repeat(made[:1], 200, axis=0)))  # a third are copies
    rows = [(i, [float(c) for c in v], "n", 1) for i, v in enumerate(made)]
    odd = [(9000, None, None, None), (9001, [1.0, None, 2.0, 1.0, 1.0, 1.0], "", 0), (9002, [math.nan] * 6, "", 0), (9003, [math.inf] + [0.0] * 5, "", 0), (9004, [], "", 0), (9005, [1.0], "", 0), (9006, [3e38] * 6, "", 0)]
    vectors = white.quantised(spark.createDataFrame(rows + odd, VECTORS).repartition(5))
    compare(white.whiten(vectors, white.fit(vectors)).collect(), list(range(600)), made)


def test_whitening_of_little(spark):
    assert white.fit(white.quantised(spark.createDataFrame([], VECTORS))) is None
    same = white.quantised(spark.createDataFrame([(1, [0.5, -0.1], "", 1), (None, [0.5, -0.1], "", 1)], VECTORS))
    rows = white.whiten(same, white.fit(same)).collect()
    assert len(rows) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in rows)
    line = white.quantised(spark.createDataFrame([(k, [float(k), 2.0 * k], "", 1) for k in range(5)], VECTORS))
    rows = sorted(white.whiten(line, white.fit(line)).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert rows[1]["whitened"] is None and abs(abs(rows[0]["whitened"]) - math.sqrt(2)) < 1e-12 and rows[0]["identity_error"] < 1e-12


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3, -4], [1 << 20, 5]])
    assert white.deviations(x, 10**6, (7, 9)) == [sum((10**6 * int(v) - s) ** 2 for v, s in zip(r, (7, 9))) if k == 0 else None for k, r in enumerate(x)]


def test_the_whitening_query_matches_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(white.query(spark, sf_dir).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    assert white.query(spark, sf_dir).agg(F.max("component")).first()[0] == 4
