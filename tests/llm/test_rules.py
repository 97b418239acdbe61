"""Personal data, branch merges and Merkle manifests against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import merge, merkle, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, tree string, nth long, line string"
EDGES = [(1, None, None, None, None), (2, "", "", "", 0), (None, "a\nb", "en", "s", 3), (4, "x" * 300_000, "en", None, 7), (4, "twice", "en", "s", 5), (4, "twice", "en", "s", 5), (5, "é\U0001f600\n\n+", None, "s", 1), (-9, "a\r\nb", "en", "s", 4)]


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, n, 1, "t", 2, "k") for i, t, lang, source, n in rows], SCHEMA)


# --- personal data


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def brute_base(text):
    """The contract's patterns, as they are."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def found(spark, texts):
    rows = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find(rows).collect()}


def test_base_spans_of_random_texts(spark):
    rng = random.Random(7)
    pieces = ["a", "b.c", "@", ".", "-", " ", "+", "1", "25", "255", "300", "0012", "4111111111111111", "4111-1111 1111 1111", "(", ")", "_", "%", "é", "\U0001f600", "\n", "x@y.z", "+1 (017) 555-7713", "97.51.17.173", "9807915762804490"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "x@y", "999999.1.1.1 1.1.1.1", "+1" + " " * 50 + "2", "", " "]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == brute_base(text), text


def test_long_runs(spark):
    """Runs that invite recursion or retries at each place."""
    n = 300_000
    texts = ["a" * n, "1" * n, "1 " * n, "1.1." * n, "+1" + "(" * n, "a@" * n, "+1 " * n, "a@b." + "c." * n, "AB12" + "CDEF" * n, "a." * n + "@b.c"]
    got = found(spark, texts)
    assert got[9] == [("email", 0, 2 * n + 4)] and got[0] == got[1] == got[2] == []
    assert len(got[3]) == n // 2 and got[3][-1][0] == "ip"


def test_other_kinds(spark):
    cases = [
        ("pay to DE89 3704 0044 0532 0130 00 now", ["iban"]), ("GB82WEST12345698765432.", ["iban"]), ("DE89 3704 0044 0532 0130 01", []), ("order DE89370400440532013000", []), ("XDE89370400440532013000", []),
        ("amex card 378282246310005", ["short_card"]), ("378282246310005", []), ("card 378282246310006", []), ("ssn: 123-45-6789", ["ssn"]), ("123-45-6789", []), ("ssn 000-45-6789", []),
        ("call (212) 555-0123", ["local_phone"]), ("tel. 212.555.0123", ["local_phone"]), ("212-555-0123", []), ("phone version 212-555-0123", []),
    ]
    got = found(spark, [text for text, _ in cases])
    for i, (text, want) in enumerate(cases):
        assert [k for k, _, _ in got[i]] == want, text
    row = spark.range(1).select(*[pii.remainder_97(F.lit(x)) for x in ("GB82WEST12345698765432", "FR1420041010050500013M02606", "FR1420041010050500013M02607")]).first()
    assert row[0] == row[1] == 1 != row[2]
    scores = {r.doc_id: [s.score for s in r.found] for r in pii.find(frame(spark, [(1, "card 4111111111111111", "", "", 1), (2, "4111111111111111", "", "", 1), (3, "order 4111111111111111", "", "", 1)])).collect()}
    assert scores == {1: [100], 2: [70], 3: [40]}


def test_personal_data_edges(spark):
    got = pii.find(frame(spark, EDGES))
    assert got.columns == ["doc_id", "found"] and got.count() == len(EDGES)
    assert pii.find(frame(spark, [])).count() == 0


# --- branch merges


def three(base, left, right):
    """(state, kind of outcome) of one unit."""
    if left == base and right == base:
        return base, None
    if left == base or right == base or left == right:
        return (right if left == base else left), "clean"
    return base, "conflict"


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 11


def brute_merge(rows):
    out, added = [], defaultdict(list)
    for doc_id, text, lang, source, _ in rows:
        text, lang, source = text or "", lang or "", source or ""
        lines = text.split("\n")
        n = {"clean": 0, "edit_edit": 0, "edit_delete": 0, "insert_insert": 0}
        edit = lambda v, c: {0: "", 1: v + "!", 2: v + "?"}.get(c, v)
        whole = {b: code(b, doc_id, "row") for b in "LR"}
        for b, shift in (("L", 1), ("R", 2)):
            if whole[b] in (3, 4):
                added[None if doc_id is None else -shift - doc_id].append((lang, source, "!?"[whole[b] - 3]))
        columns = {c: [edit(v, code(b, doc_id, c)) for b in "LR"] for c, v in (("lang", lang), ("source", source))}
        codes = [[code(b, doc_id, i) for b in "LR"] for i in range(len(lines))]
        gone = {b: whole[b] == 0 for b in "LR"}
        if any(gone.values()):
            other = 1 if gone["L"] else 0
            changed = any(c[other] <= 4 for c in codes) or columns["lang"][other] != lang or columns["source"][other] != source
            if all(gone.values()) or not changed:
                out.append((doc_id, None, None, None, 1, 0, 0, 0))
            else:
                out.append((doc_id, lang, source, text, 0, 0, 1, 0))
            continue
        values = {}
        for c, v in (("lang", lang), ("source", source)):
            values[c], how = three(v, *columns[c])
            n["clean"] += how == "clean"
            n["edit_edit"] += how == "conflict"
        made = []
        for line, both in zip(lines, codes):
            state, how = three("keep", *[{0: "drop", 1: "!", 2: "?"}.get(c, "keep") for c in both])
            n["clean"] += how == "clean"
            n["edit_delete" if 0 in both else "edit_edit"] += how == "conflict"
            made += [] if state == "drop" else [line + ("" if state == "keep" else state)]
            state, how = three("", *[{3: "!", 4: "?"}.get(c, "") for c in both])
            n["clean"] += how == "clean"
            n["insert_insert"] += how == "conflict"
            made += [state] if state else []
        out.append((doc_id, values["lang"], values["source"], "\n".join(made), *n.values()))
    for doc_id, states in added.items():
        alike = len(set(states)) == 1
        out.append((doc_id, *(states[0] if alike else (None,) * 3), int(alike), 0, 0, int(not alike)))
    return sorted(out, key=repr)


def test_branches(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(["", "a", "b b", "é", "!"]) for _ in range(rng.randint(1, 9))), rng.choice(["en", "", None]), rng.choice(["s", None]), 0) for i in range(1500)]
    rows += [*EDGES, (3000, "\n".join(map(str, range(40_000))), "en", "s", 0)]
    got = merge.merge(frame(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
    want = brute_merge(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert all(any(r[k] for r in want) for k in range(4, 8))
    assert merge.merge(frame(spark, [])).count() == 0


def test_branches_of_other_columns(spark):
    rows = frame(spark, [(i, "a", "en", "s", 0) for i in range(200)])
    got = {r.doc_id: r.line for r in merge.merge(rows, columns=["line"]).where("doc_id >= 0").collect()}
    for i in range(200):
        if not any(code(b, i, "row") == 0 for b in "LR"):
            assert got[i] == three("k", *[{0: "", 1: "k!", 2: "k?"}.get(code(b, i, "line"), "k") for b in "LR"])[0]


# --- Merkle manifests


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves, fanout):
    """The root, and for each leaf its siblings level by level."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[a : a + fanout] for a in range(0, len(nodes), fanout)]
        for i, at in enumerate(where):
            run = runs[at // fanout]
            paths[i].append((run[: at % fanout], run[at % fanout + 1 :]))
            where[i] = at // fanout
        nodes = [digest(*run) for run in runs]
    return nodes[0], paths


def brute_manifest(rows, fanout=2, tampered=lambda i: zlib.crc32(str(i).encode()) % 7 == 0):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest(*map(show, (r[0], r[3], r[2], n, r[1])))
    trees = defaultdict(list)
    for r in rows:
        n = r[4] + 1 if r[4] is not None and r[0] is not None and tampered(r[0]) else r[4]
        trees[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r[0], leaf(r, r[4]), leaf(r, n)))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: climb([x[2] for x in sorted(trees[t])], fanout) for t in order}
    root, tops = climb([made[t][0] for t in order], fanout)
    out = []
    for t, top in zip(order, tops):
        for (_, doc_id, own, given), path in zip(sorted(trees[t]), made[t][1]):
            now, proof = given, ""
            for before, after in [*path, *top]:
                now, proof = digest(*before, now, *after), proof + "".join([*before, *after])
            out.append((doc_id, own, made[t][0], root, digest(proof), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, levels", [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest(spark, fanout, levels):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["x", "é\n", None, ""]), rng.choice(["en", "en", "de", None, "", "é", "Z"]), rng.choice(["s", None]), rng.choice([None, i])) for i in rng.sample(range(500), 230)]
    rows += [*EDGES, (7, "alone", "only", "s", 2)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    given = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(frame(spark, rows).repartition(3), given=given, fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows, fanout)


def test_manifest_edges(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    assert [r.verified for r in merkle.manifest(frame(spark, EDGES[:1])).collect()] == [True]
    row = merkle.manifest(frame(spark, EDGES[1:2])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, []), fanout=1)
