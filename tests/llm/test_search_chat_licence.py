import re
import itertools
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from accordis.llm import chat, license, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=24):
    rng = random.Random(4)
    out = [(i, [rng.gauss(0, 1) for _ in range(dim)], 0) for i in range(n)]
    out += [(1000 + i, out[7][1], 0) for i in range(30)]  # ties
    out += [(2000, None, 0), (2050, [1.0, None], 0), (2100, [math.nan] * dim, 0), (2150, [math.inf] * dim, 0), (None, [1.0] * dim, 0), (2200, [], 0), (2250, [1e6] * dim, 0)]
    return out


def test_topk_equals_brute_force(spark):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    sound = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = set()
    for q, x in sound:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in sound if c != q and len(y) == len(x))
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(found[:5])}
    assert {tuple(r) for r in topk.search(df).collect()} == want
    assert {tuple(r) for r in topk.search(df, block=2).collect()} == want
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0


def cheapest(roles):
    """The lowest cost over all sequences of states."""
    best = {chat.START: 0}
    for role in roles:
        ahead = defaultdict(lambda: chat.INFINITE)
        for state, to in itertools.product(best, range(1, 4)):
            for a, b, cost, _, _ in chat.steps(role):
                if (a, b) == (state, to):
                    ahead[to] = min(ahead[to], best[state] + cost)
        best = ahead
    return min(best.values())


TURNS = "conv_id long, turn long, role string, text string, part int"


def conversations():
    rng = random.Random(6)
    out = [(c, t, rng.choice(["user", "assistant", "system", " User ", "tool", None]), rng.choice(["hi", "", None]), 1) for c in range(40) for t in range(rng.randint(1, 9))]
    out += [(99, t, rng.choice(["user", "assistant", "user"]), f"t{t}", 1) for t in range(400)]
    return [*out, (None, 0, "user", "x", 1), (41, None, "user", "x", 1), (41, None, "user", "x", 1)]


def cost_of(turns, got):
    """Cost of the output of one conversation: turns are sorted input rows, got the rows for them in the same order."""
    total, state = 0, chat.START
    for (_, _, role, _, _), r in zip(turns, got, strict=True):
        to = chat.ROLES[r["role"]]
        total += min(s[2] for s in chat.steps(chat.role_of(role)) if s[:2] == (state, to))
        state = to
    return total


def test_repair_is_legal_and_cheapest(spark):
    rows = conversations()
    got = chat.repaired(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    kept = [r for r in got if r["part"] == 1]
    assert len(kept) == len(rows)
    by_turn = lambda r: (r[1] is not None, r[1] or 0)
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=by_turn)
        out = sorted((r for r in kept if r["conv_id"] == conv), key=lambda r: (r["turn"] is not None, r["turn"] or 0))
        assert cost_of(turns, out) == cheapest([chat.role_of(r[2]) for r in turns])
        assert [r["text"] for r in out] == [r[3] or "" for r in turns]
    for r in got:
        assert r["rendered"] == (f"{r['text']}\n" if r["action"] == "merge" else f"<|{r['role']}|>\n{r['text']}\n")


def test_a_long_conversation_is_repaired_as_one(spark):
    """Parts in several tasks give the same steps as one pass over all turns."""
    rows = [(1, t, random.Random(t).choice(["user", "user", "assistant"]), "x", 0) for t in range(2000)]
    df = spark.createDataFrame(rows, TURNS)
    got = [r for r in chat.repaired(df).collect() if r["part"] == 1]
    path = chat.repair([chat.role_of(r[2]) for r in rows])
    assert cost_of(rows, sorted(got, key=lambda r: r["turn"])) == sum(s[2] for s in path)


def by_force(roles):
    """The first of all cheapest repairs, in the order that the operator promises, out of every legal one."""
    found = [((), chat.START, 0)]
    for role in roles:
        found = [(path + ((k, s),), s[1], cost + s[2]) for path, state, cost in found for k, s in enumerate(chat.STEPS[role]) if s[0] == state]
    return [s for _, s in min(found, key=lambda f: (f[2], f[1], [k for k, _ in reversed(f[0])]))[0]]


def test_repair_equals_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        roles = [rng.choice([None, chat.SYSTEM, chat.USER, chat.ASSISTANT]) for _ in range(rng.randint(1, 5))]
        assert chat.repair(roles) == by_force(roles)


def test_repair_is_the_same_on_any_partitions(spark):
    """Whole outputs, of conversations that lie across many partitions or in one, agree, also with the plain repair of each."""
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), "x" * rng.randint(0, 3), 1) for c in range(12) for t in range(60)]
    rows += [(50, t, rng.choice(["user", "tool"]), "y" * 2000, 1) for t in range(300)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    outs = []
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        outs.append(sorted(map(tuple, chat.repaired(spark.createDataFrame(rows, TURNS)).collect())))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert outs[0] == outs[1] == outs[2]
    for conv in {r[0] for r in rows}:
        path = chat.repair([chat.role_of(r[2]) for r in rows if r[0] == conv])
        assert [r[3] for r in outs[0] if r[0] == conv and r[2] == 1] == [chat.NAMES[s[1]] for s in path]


def test_bounds_drop_most_pairs():
    """Survivors fall level by level, and what is left holds the best of all."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3000, 48)) * np.linspace(2, 0.1, 48) * 256).astype(np.int64)
    ids = np.arange(3000)
    s = topk.Searcher(ids[::50], x[::50], 5)
    s.add(ids, x)
    assert (np.diff(s.left) <= 0).all() and s.left[-1] < 0.05 * s.left[0]
    full = x[::50] @ x.T
    for number, i in enumerate(ids[::50]):
        full[number, i] = -(1 << 60)
        assert s.rows[s.rows[:, 0] == number, 1].tolist() == np.lexsort((ids, -full[number]))[:5].tolist()


def test_chat_of_nothing(spark):
    assert chat.repaired(spark.createDataFrame([], TURNS)).count() == 0


def test_licence_lines(spark):
    lines = {0: "Released under the MIT License.", 1: "Licensed under the Apache License, Version 2.0.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.", 4: "He lost his driving licence in the rain.", 5: "No such words here."}
    rows = [(i, f"some words before\n{t}\nsome words after") for i, t in lines.items()] + [(10, None), (11, ""), (None, lines[0]), (12, lines[0] + "\n" + lines[1]), (12, lines[0] + "\n" + lines[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license.scan(docs, license.fit(docs))
    found = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in got.filter("unit = 'line'").collect()}
    assert found == {(0, 1): ("mit", True), (1, 1): ("apache", True), (2, 1): ("gpl", True), (3, 1): ("cc-by-nc", True), (4, 1): ("unknown", False), (None, 0): ("mit", True), (12, 0): ("mit", True), (12, 1): ("apache", True)}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_licence_lines_without_cue_words(spark, monkeypatch):
    """Notices without a cue word and in other languages; bounds drop no line that scoring every line names."""
    lines = {0: ("gpl", "Distributed under the GNU General Public v3"), 1: ("gpl", "Published under GPL-3.0"), 2: ("cc-by", "CC BY 4.0"), 3: ("apache", "Apache-2.0"), 4: ("gpl", "Licensing: GPLv3"), 5: ("gpl", "Lizenziert unter der GNU General Public License, Version 3"), 6: ("mit", "Licencia MIT"), 7: ("mit", "Lizenz: MIT"), 8: ("mit", 'The software is provided "as is", without warranty of any kind.')}
    plain = ["Er kam mit dem Zug nach Hause.", "All of this was under the table.", "The general public came by train.", "We use version 4.0 of this work."]
    rows = [(i, f"some words before\n{t}\nsome words after") for i, (_, t) in lines.items()] + [(100 + i, t) for i, t in enumerate(plain * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = license.fit(docs.filter("doc_id >= 100"))
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license.scan(docs, model).filter("unit = 'line'").collect()}
    assert {r for r in got if r[0] < 100} == {(i, 1, f) for i, (f, _) in lines.items()}
    assert not [r for r in got if r[0] >= 100]
    monkeypatch.setattr(license.Model, "least", lambda self: -1e9)
    model.strong = None
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in license.scan(docs, model).filter("unit = 'line'").collect()} == got


def test_licence_wrapped_notices_and_odd_tables(spark):
    """A notice that is wrapped over lines; very long lines, empty tables and columns with clashing names."""
    wrapped = "An ordinary sentence ends here.\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software and associated documentation files\n\nAnother one."
    rows = [(0, wrapped, "x", "y", 1), (1, "word " * 200_000 + "\nMIT License\n", None, None, 2), (2, None, None, None, None), (3, "  \n\n \n", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string, unit string, paragraph int")
    model = license.fit(docs)
    got = [r for r in license.scan(docs, model).collect() if r["family"] != "unknown"]
    assert [(r["paragraph"], r["family"], r["confirmed"]) for r in got if r["doc_id"] == 0 and r["unit"] == "run"] == [(1, "mit", True)]
    assert (1, 1, "mit") in [(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["unit"] == "line"]
    assert {r["doc_id"] for r in got} == {0, 1}
    none = docs.limit(0)
    assert license.scan(none, license.fit(none)).count() == 0


def test_licence_scan_equals_brute_force(spark, docs):
    """Probabilities of every line, by plain Python from the model's weights."""
    import re

    lines = ["Licensed under the Apache License, Version 2.0.", "GPL-3.0", "no licence at all", "Licencia MIT"]
    more = spark.createDataFrame([(900 + i, f"first words\n{t}") for i, t in enumerate(lines)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    s = license.Settings()
    model = license.fit(df, s)
    rows = {(r["doc_id"], r["text"]) for r in df.collect()}
    word = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
    grams = {key: set(w) | {" ".join(p) for p in zip(w, w[1:], strict=False)} for i, t in rows for n, line in enumerate((t or "").split("\n")) for key, w in [((i, n, line), word.findall(line.lower()))]}
    names = sorted(set().union(*grams.values()))
    hashes = dict(map(tuple, spark.createDataFrame([(g,) for g in names], "g string").select("g", license.hashed(F.col("g"), s.hash_bits)).collect()))
    want = {}
    for (i, n, line), gs in grams.items():
        held = {hashes[g] for g in gs}
        z = np.array([model.weights.get(h, [0.0] * (len(license.FAMILIES) + 1)) for h in held]).reshape(-1, len(license.FAMILIES) + 1).sum(axis=0) / math.sqrt(max(1, len(held))) + np.array(model.bias)
        p = license.softmax(z[None, :])[0]
        family = [*license.FAMILIES, "unknown"][int(p.argmax())] if p.max() >= model.threshold else "unknown"
        if family != "unknown" or any(cue in line.lower() for cue in license.CUES):
            want[(i, n)] = (family, round(float(p.max()), 6))
    got = {(r["doc_id"], r["paragraph"]): (r["family"], round(r["probability"], 6)) for r in license.scan(df, model, s).filter("unit = 'line'").collect()}
    assert got == want and len(want) >= 3


def test_chat_keeps_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(1, 0, "assistant", long, 1), (1, 1, "assistant", None, 1), (1, 2, "user", "", 1)]
    got = [r for r in chat.repaired(spark.createDataFrame(rows, TURNS)).collect() if r["part"] == 1]
    assert sorted(len(r["text"]) for r in got) == [0, 0, len(long)] and max(len(r["rendered"]) for r in got) > len(long)


def test_pattern_of_words_finds_what_an_alternation_finds(spark):
    words = ["a", "ab", "abc", "b-c", "2.0", "gpl-3.0", "gpl", "über", "(c)"]
    texts = ["ab", "abd", "xabc", "abc.", "the gpl-3.0-or", "gpl3", "2.01", "2x0", "b-c", "ab-c", "über!", "naüber", "(c)", "", "a", "nothing", "gpl\u2014x", "\u00abab\u00bb", "\u4e2dab", "1abc", "abc1 abc"]
    plain = r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_like("t", F.lit(plain)).alias("a"), F.regexp_like("t", F.lit(license.whole_words(words))).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and 5 < sum(r["a"] for r in rows) < len(rows)
    assert spark.range(1).select(F.regexp_like(F.lit("a"), F.lit(license.whole_words([])))).first()[0] is False


def test_licence_threshold_comes_from_all_lines(spark):
    """Lines that look like a licence, all in a text of which the training sample takes another line, raise the threshold."""
    words = "amber basil cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry river stone trail".split()
    rows = [(i, "\n".join(" ".join(words[(i * 7 + j * 3 + k) % 20] for k in range(8)) + f" {i}x{j}." for j in range(5))) for i in range(100)]
    first = spark.range(2000).select(F.concat(F.lit("start "), "id", F.lit(".")).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(41)) == 0).first()[0]
    docs = spark.createDataFrame([*rows, (900, "\n".join([first] + ["The GPL grew."] * 40)), (901, "Licensed under the MIT License.")], "doc_id long, text string")
    model = license.fit(docs)
    got = license.scan(docs, model).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(901, "mit")} and 0.5 < model.threshold <= 0.9
    assert sorted(map(str, license.fit_and_scan(docs).collect())) == sorted(map(str, got))
