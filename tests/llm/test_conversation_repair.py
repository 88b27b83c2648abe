import hashlib
import itertools
import random
import zlib

import pandas as pd
import pytest
import xxhash

from cases import SF, rows_of
from dealerlens.llm import conversation_repair as op

REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by plain forward search over all states: the least (cost, string) of each."""
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (c, a, r) in list(best.items()):
                for i, name in names.items():
                    if (t := nxt.get((s, i))) is not None:
                        best[t] = min(best.get(t, (1e9, "", ())), (c + 2, a + "I", (*r, f"{name}:")))
        return best

    for role, text, must_go, cut in rows:
        new = {}
        for s, (c, a, r) in inserted(best).items():
            options = [(s, c + 3, "D", r)]
            if not must_go:
                options += [(nxt[s, i], c + 2 + cut, "R", (*r, f"{n}:{text}")) for i, n in names.items() if (s, i) in nxt]
                if (s, role[:1]) in nxt:
                    options.append((nxt[s, role[:1]], c + cut, "K", (*r, f"{role}:{text}")))
            for t, cost, e, kept in options:
                new[t] = min(new.get(t, (1e9, "", ())), (cost, a + e, kept))
        best = new
    end = inserted(best)
    return min(end[s] for s in (0, 3) if s in end)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        convs.setdefault(conv, []).append(((turn is not None, turn or 0, role, text[:64], h - (h >> 63 << 64)), turn, role, text))
    out = []
    for conv, got in convs.items():
        got.sort(key=lambda r: r[0])
        seen, faults = set(), []
        for _, _, role, text in got:
            inner = text.strip(op.BLANKS)
            faults.append("b" if not inner else "d" if (role, text) in seen else "t" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, kept = cheapest([(r[2], r[3], f in ("b", "d"), f == "t") for r, f in zip(got, faults, strict=True)])
        turns = [r[1] for r in got if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(got))
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, convs=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?\n", None, "One more thing.", "Good. "]
    return [(rng.choice([conv, conv, None]) if conv % 9 == 0 else conv, rng.choice([turn, turn, turn + 1, None]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts + [f"Turn {turn}."]))
            for conv in range(convs) for turn in range(rng.choice([1, 2, 5, 9]))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, conv string")


def spaced(rows):
    return [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]


@pytest.mark.parametrize("seed", range(3))
def test_reports_equal_plain_search(spark, seed):
    rows = made_up(seed)
    assert rows_of(op.report(frame(spark, rows)), "conv", *REPORT) == brute(spaced(rows))


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, turn, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["Ok.", "cut", "", f"T{turn}."])) for turn in range(3000)]
    rows += made_up(8, 12)
    frame_ = frame(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(op.report(frame_), "conv", *REPORT)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(spaced(rows))


def test_rows_of_the_repair_are_what_the_report_tells(spark):
    rows = made_up(11)
    edits = {}
    for r in op.repair(frame(spark, rows)).orderBy("conv", "place").collect():
        edits.setdefault(r.conv, []).append(r)
    for conv, *_, audit, digest in rows_of(op.report(frame(spark, rows)), "conv", *REPORT):
        got = edits[conv]
        assert "".join(r.edit for r in got) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got if r.edit != "D").encode()).hexdigest() == digest


def test_matrices_join_to_the_whole():
    rng = random.Random(3)
    codes = bytes(rng.randrange(len(op.CODES)) for _ in range(200))
    whole, _, cost = op.walk(codes, op.END)
    for cut in (0, 1, 77, 199):
        after = op.joined(op.matrix(codes[cut:]), op.END)
        assert op.joined(op.matrix(codes[:cut]), after)[0] == cost
        least = min(after)
        head, state, _ = op.walk(codes[:cut], tuple(x - least for x in after))
        assert head + op.walk(codes[cut:], op.END, state)[0] == whole


def test_empty_table_and_conversations_without_rows(spark):
    assert op.report(frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
    assert op.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
    assert rows_of(op.report(frame(spark, [(1, None, "user", None)])), "conv", *REPORT) == [(1, 0, 1, 0, 0, 0, 3, "D", EMPTY[-1])]


def test_query_equals_plain_search_over_the_table(spark, sf):
    t = pd.read_parquet(f"{SF}/conversations.parquet")
    rows = list(t[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    found = {r[0]: r[1:] for r in brute(damage(rows))}
    want = sorted(((c, *found.get(c, EMPTY)) for c in {r[0] for r in rows}), key=repr)
    assert rows_of(op.op12_conversation_repair(spark, sf), "conv_id", *REPORT) == want
