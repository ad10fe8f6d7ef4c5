"""Exact copies, repaired conversations and Merkle manifests next to plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeskein.llm import chat_repair, exact_copies, merkle

SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- exact copies ---


def plain_copies(rows):
    """Rows (doc_id, text) to sorted (doc_id, keep_id, group_size, sha) and the number kept of each group."""
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(SPACES), []).append((-len(t or ""), d is None, d or 0, d))
    return bag((r[3], min(g)[3], len(g), sha(t)) for t, g in groups.items() for r in g), len(groups)


def check_copies(got, rows):
    expected, n_groups = plain_copies(rows)
    got = got.collect()
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n_groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_copies_of_odd_rows(spark, odd, nothing):
    check_copies(exact_copies.exact_copies(odd.withColumns({"digest": F.lit(1), "lane": F.lit(2), "proof": F.lit(3)})), odd.select("doc_id", "text").collect())
    assert exact_copies.exact_copies(nothing).collect() == []


def test_copies_with_colliding_digests_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i % 97, i]), rng.choice([" a", "a ", "a", "", None, "\t", "b c", "bc", f"t {i % 50}"])) for i in range(1500)]
    rows += [(None, None)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    check_copies(exact_copies.exact_copies(df), rows)
    check_copies(exact_copies.exact_copies(df, digest=lambda t: F.pmod(F.length(t), F.lit(2))), rows)
    check_copies(exact_copies.exact_copies(df, digest=lambda t: F.lit(-1)), rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 3)), max_size=8), min_size=1, max_size=5))
def test_merging_runs_is_merging_their_rows(parts):
    def run(rows):
        out = np.zeros(len(rows), exact_copies.ENTRY)
        for i, (digest, proof, chars) in enumerate(rows):
            out[i] = (digest, proof, 0, 0, 0, 0, chars, 0, i, i, 1)
        return out

    runs = [exact_copies.merged([run(p)]) for p in parts]
    assert exact_copies.merged(runs).tolist() == exact_copies.merged([run(p) for p in parts]).tolist()


# --- conversations ---

SHAPES = {("", "u"), ("", "s"), ("s", "u"), ("u", "a"), ("a", "u")}


def shaped(initials):
    return not initials or (initials[-1] == "a" and all(p in SHAPES for p in zip(["", *initials], initials)))


def plain_repair(codes):
    """Least (cost, audit) over all repairs, state by state with whole strings."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def insert(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                to = "a" if q == "u" else "u"
                best[to] = min(best.get(to, (9**9, "")), (c + 3, a + "I"))
        return best

    best = insert(best)
    for code in codes:
        role, fault = divmod(ord(code) - 65, 4)
        then = {}
        for q, (c, a) in best.items():
            ways = [(q, c + 4, a + "D")]
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                if "suax"[role] in moves[q]:
                    ways.append(("suax"[role], c + extra, a + "K"))
                ways.append(("a" if q == "u" else "u", c + extra + 3, a + "R"))
            for to, cost, audit in ways:
                then[to] = min(then.get(to, (9**9, "")), (cost, audit))
        best = insert(then)
    return min(best[q] for q in ("", "a") if q in best)


def every_repair(codes):
    """Least (cost, audit) by trying all edits, for short conversations."""
    found = []

    def go(i, initials, cost, audit, inserted):
        if inserted < 3:
            for role in "ua":
                go(i, initials + [role], cost + 3, audit + "I", inserted + 1)
        if i == len(codes):
            if shaped(initials):
                found.append((cost, audit))
            return
        role, fault = divmod(ord(codes[i]) - 65, 4)
        go(i + 1, initials, cost + 4, audit + "D", 0)
        if fault not in (1, 2):
            extra = 3 if fault == 3 else 0
            go(i + 1, initials + ["suax"[role]], cost + extra, audit + "K", 0)
            for new in "ua":
                go(i + 1, initials + [new], cost + extra + 3, audit + "R", 0)

    go(0, [], 0, "", 0)
    return min(found)


CODES = st.text(alphabet=[chr(65 + i) for i in range(16)], max_size=40)


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet=[chr(65 + i) for i in range(16)], max_size=3))
def test_plain_repair_is_least_of_all(codes):
    assert plain_repair(codes) == every_repair(codes)


@settings(max_examples=300, deadline=None)
@given(CODES, st.sampled_from([(1_000_003, (1 << 61) - 1), (1, 1), (2, 3)]))
def test_programme_and_verified_collisions(codes, hashing):
    ends = chat_repair.solved(codes, 0, True, chat_repair.Audits(*hashing))
    assert min(ends[q] for q in chat_repair.ENDS if q in ends) == plain_repair(codes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=[chr(65 + i) for i in range(16)], min_size=1, max_size=9), min_size=1, max_size=6))
def test_chunks_join_to_the_whole(chunks):
    tables = [{0: chat_repair.solved(chunks[0], 0, True)}]
    tables += [{q: chat_repair.solved(c, q, False) for q in range(4)} for c in chunks[1:]]
    steps = chat_repair.joined(tables)
    assert (sum(c for c, _ in steps), "".join(a for _, a in steps)) == plain_repair("".join(chunks))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "ab", "aab"])), min_size=1, max_size=30), st.sampled_from([(31, 1 << 61), (1, 1)]))
def test_shared_strings(adds, hashing):
    audits, texts = chat_repair.Audits(*hashing), [""]
    for parent, label in adds:
        parent %= len(texts)
        texts.append(texts[parent] + label)
        assert audits.add(parent, label) == len(texts) - 1
    for i, a in enumerate(texts):
        assert audits.text(i) == a and audits.text(i, len(a) // 2) == a[: len(a) // 2]
        for j, b in enumerate(texts):
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert audits.common(i, j) == n and audits.less(i, j) == (a < b)


def plain_conversations(rows):
    """conv_id to the contract's columns, of rows (conv_id, turn, role, text, gone)."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = [(t is not None, t or 0, bytes.fromhex(sha(f"{len(r)}:{r}{x}")), t, r, x) for k, t, r, x, gone in rows if k == c and not gone]
        mine.sort(key=lambda m: m[:3])
        codes, seen, turns = "", set(), [m[3] for m in mine if m[3] is not None]
        for *_, r, x in mine:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (r, x) in seen else 0 if bare[-1] in ".!?" else 3
            seen.add((r, x))
            codes += chr(65 + 4 * ("sua".index(r[0]) if r[:1] and r[0] in "sua" else 3) + fault)
        cost, audit = plain_repair(codes)
        lines, state, at = [], "", 0
        for edit in audit:
            need = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{need}:")
                state = need[0]
                continue
            *_, r, x = mine[at]
            at += 1
            if edit in "KR":
                role = r if edit == "K" else need
                lines.append(f"{role}:{x}")
                state = role[0]
        initials = ["suax"[(ord(k) - 65) // 4] for k in codes]
        illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [(ord(k) - 65) % 4 for k in codes]
        out[c] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, sha("\n".join(lines)))
    return out


def conversations(df):
    got = df.collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


SAID = "conv_id long, turn long, role string, text string, gone boolean"


def test_repair_of_odd_conversations(spark):
    rows = [
        (None, 1, "user", "x.", False), (None, None, "assistant", "y", False), (1, 0, " ", " ", False), (1, 1, "tool", "ok!", False), (1, 1, "", "no", False),
        (2, 5, "assistant", "long. " * 40_000, False), (3, 0, "user", "a?", False), (3, 0, "user", "a?", False), (3, 9, "assistant", "ü\U0001f600", False),
        (4, 0, "user", "gone", True), (5, None, "system", "a.", False), (5, None, "system", "b.", False), (6, 2, "user", "stays.", False), (6, 1, "user", "gone", True),
        *[(7, 3, "user", "all the same.", False)] * 40,
    ]
    df = spark.createDataFrame(rows, SAID).withColumns({"block": F.lit(1), "code": F.lit(2), "mark": F.lit(b"m")})
    assert conversations(chat_repair.repaired(df)) == plain_conversations(rows)
    assert chat_repair.repaired(df.limit(0)).collect() == []


def test_repair_of_a_conversation_of_many_chunks(spark):
    rng = random.Random(3)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{i}.", f"{i}"]), rng.random() < 0.05) for i in range(5000)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"{c} {i}.", False) for c in range(2, 40) for i in range(60)]
    df = spark.createDataFrame(rows, SAID).repartition(5)
    assert conversations(chat_repair.repaired(df)) == plain_conversations(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", f"{c}. {t}! a? b") for c in (1, 2, None) for t in [None, *range(40)]] + [(9, 1, None, None)]
    expected = []
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(harm, text)
        expected += [(c, t, "user" if harm == 4 else role, text, harm == 0)] * (2 if harm == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("harm", F.lit(0))
    assert bag(chat_repair.damaged(df).collect()) == bag(expected)


# --- manifests ---


def plain_manifest(rows, lowered=lambda d: False):
    """The contract's rows of (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, path in enumerate(paths):
                k = at[i] - at[i] % 8
                path.append(("".join(level[k : at[i]]), "".join(level[at[i] + 1 : k + 8])))
                at[i] //= 8
            level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], paths

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *tree([leaf(r) for r in mine])))
    if not trees:
        return []
    root, tops = tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for r, path in zip(mine, paths):
            now = leaf(r[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]),)) if lowered(r[0]) and r[4] is not None else leaf(r)
            for before, behind in path + top:
                now = sha(before + now + behind)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path + top)), now, now == root))
    return bag(out)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(df):
    return bag(merkle.proved(df, merkle.lower_cased(F.col("text")), F.col("doc_id") % 3 == 0).collect())


def third(doc_id):
    return doc_id is not None and doc_id % 3 == 0


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (8, 1), (9, 1), (2, 2), (70, 3), (40, 30), (600, 2)])
def test_manifest(spark, n, langs):
    rng = random.Random(n)
    names = [None, "", "-", *map(str, range(langs))][-langs:] if langs > 2 else ["x", "ü"][:langs]
    rows = [(rng.choice([None, i, i]), rng.choice([None, "s"]), rng.choice(names), i, rng.choice([None, "", "AbÄ", "x"])) for i in range(n)]
    rows += rows[:3]
    assert manifest(spark.createDataFrame(rows, FIELDS)) == plain_manifest(rows, third)


def test_manifest_of_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    clashing = odd.withColumns({"tree": F.lit(1), "at": F.lit(2), "digest": F.lit(3), "path": F.lit(4)})
    assert manifest(clashing) == plain_manifest(rows, third)


def test_changed_field_breaks_the_proof(spark):
    rows = [(i, "s", "x", i, f"Text {i}" if i % 2 else f"text {i}") for i in range(100)]
    got = merkle.proved(spark.createDataFrame(rows, FIELDS), merkle.lower_cased(F.col("text")), F.lit(True)).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(100) if i % 2}
