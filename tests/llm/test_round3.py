"""Conversation repair, Merkle manifest and BPE against brute force and the tokenizers library."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from assaylake.llm import bpe, conversations, merkle
from llm_texts import prose, words

BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- conversation repair ---------------------------------------------------------

def _faults(rows):
    """Blank, duplicate, truncated or '' of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen
                   else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows):
    """Least (cost, audit, repaired rows) over every choice of edits, by plain enumeration."""
    faults, best = _faults(rows), None
    gap = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for (role, text), fault in zip(rows, faults):
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", more, (role, text)), *(("R", 3 + more, (r, text)) for r in ("user", "assistant"))]
        choices.append(own)
    for edits in itertools.product(*choices):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost += 3 * len(gaps[k])
                audit += "I" * len(gaps[k])
                out += [(r, "") for r in gaps[k]]
                if k < len(rows):
                    letter, c, row = edits[k]
                    cost, audit = cost + c, audit + letter
                    out += [row] if row else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (
                    best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def _repair(rows):
    c = conversations.Conversation(1)
    seen = set()
    for role, text in rows:
        c.row(0, role, text.encode(), (role, text) not in seen)
        seen.add((role, text))
    return c.result()


def test_repair_equals_enumeration():
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system", "tool", "", " "]),
                 r.choice(["Hello.", "What?", "cut off", "  \n", "", "Yes!\n", "é…"])) for _ in range(r.randrange(0, 4))]
        cost, audit, out = _cheapest(rows)
        got = _repair(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def _by_pairs(rows):
    """The same search with (cost, audit, text) tuples kept whole."""
    nodes, insert = {0: (0, "", "")}, {0: 2, 1: 2, 3: 2, 2: 3}
    name = {2: "user", 3: "assistant"}

    def least(found):
        out = {}
        for s, v in found:
            out[s] = min(out.get(s, v), v)
        return out

    def put(s, body, line):
        return line if s == 0 else f"{body}\n{line}"

    def gaps(nodes):
        return least([*nodes.items(), *((insert[s], (c + 3, a + "I", put(s, b, name[insert[s]] + ":")))
                                        for s, (c, a, b) in nodes.items())])

    for (role, text), fault in zip(rows, _faults(rows)):
        found, more = [], 3 if fault == "truncated" else 0
        for s, (c, a, b) in gaps(nodes).items():
            found.append((s, (c + 4, a + "D", b)))
            if fault not in ("blank", "duplicate"):
                to = insert[s]
                found.append((to, (c + 3 + more, a + "R", put(s, b, f"{name[to]}:{text}"))))
                if role[:1] == name[to][0] or (role[:1] == "s" and s == 0):
                    found.append((1 if role[:1] == "s" else to, (c + more, a + "K", put(s, b, f"{role}:{text}"))))
        nodes = least(found)
    return min(v for s, v in gaps(nodes).items() if s in (0, 3))


@pytest.mark.parametrize("roles", ["user assistant", "tool", "user assistant system tool assistant"])
def test_long_repairs_settle_and_widen(roles):
    r = random.Random(5)
    rows = [(r.choice(roles.split()), f"{k}{r.choice(['.', '', '.', ' '])}" if r.random() < 0.9 else "") for k in range(700)]
    cost, audit, body = _by_pairs(rows)
    got = _repair(rows)
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert got["repaired_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def test_weights_stay_narrow_where_paths_agree():
    c = conversations.Conversation(1)
    for k in range(20_000):
        c.row(k, ("user", "assistant")[k % 2], b"%d." % k, True)
    assert c.repair.width <= 2 * conversations.WIDTH and c.result()["audit"] == "K" * 20_000


def _told(spark, rows):
    return spark.createDataFrame([(*r, 9, b"x") for r in rows],
                                 "conv_id long, turn long, role string, text string, kind int, said binary")


def test_repair_of_nasty_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", None),
            (2, None, None, None), (None, 3, "user", "lost."), (None, None, "user", "x" * 300_000),
            (3, -(1 << 63), "user", "a."), (3, (1 << 63) - 1, "user", "b.")]
    roster = spark.createDataFrame([(1,), (7,), (7,), (None,)], "conv_id long")
    got = {r["conv_id"]: r.asDict() for r in conversations.plan_repairs(_told(spark, rows), roster).collect()}
    assert set(got) == {1, 2, 3, 7, None}
    assert got[1]["n_rows"] == 4 and got[1]["gaps"] == 3 and got[1]["duplicate"] == 1 and got[1]["blank"] == 1
    assert (got[1]["audit"], got[1]["cost"], got[1]["illegal"]) == ("KKDD", 8, 1)
    assert got[7] | {"conv_id": 0} == dict.fromkeys(got[7], 0) | {
        "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got[2]["blank"] == 1 and got[2]["gaps"] == 0 and got[2]["audit"] == "D"
    assert got[None]["n_rows"] == 2 and got[None]["gaps"] == 0 and got[None]["truncated"] == 1
    assert got[3]["gaps"] == conversations.LONG
    assert conversations.plan_repairs(_told(spark, [])).collect() == []


def test_repaired_rows_give_the_hash(spark):
    r = random.Random(9)
    rows = [(k % 40 if k % 41 else None, r.randrange(12) if k % 13 else None,
             r.choice(["user", "assistant", "system", "tool", None]), r.choice([prose(6, k), "cut", "", None, "Same."]))
            for k in range(500)]
    told = _told(spark, rows)
    plans = conversations.plan_repairs(told).cache()
    found = {}
    for row in conversations.repaired_rows(told, plans).collect():
        found.setdefault(row["conv_id"], []).append(row)
    for p in plans.collect():
        own = sorted(found.get(p["conv_id"], []), key=lambda x: x["place"])
        text = "\n".join(f"{x['role']}:{x['text']}" for x in own)
        assert hashlib.sha256(text.encode()).hexdigest() == p["repaired_sha256"]
        assert "".join(x["edit"] for x in own) == p["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in own))


def test_damage_follows_the_key(spark):
    rows = [(c, t, "system", "A. b! c?") for c in (1, 2, None) for t in [*range(60), None]]
    got = {}
    for r in conversations.damage(_told(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "A b c")], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got.get((c, t), []) == want.get(fate, [(role, text)])


# --- Merkle manifest ---------------------------------------------------------------

def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(leaves):
    """All levels of the tree, and the siblings of each leaf from the lowest on."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_h("".join(low[i:i + 8])) for i in range(0, len(low), 8)])
    return levels


def _root(leaves):
    return _tree(leaves)[-1][0]


def _siblings(leaves, i):
    out = ""
    for level in _tree(leaves)[:-1]:
        out += "".join(level[j] for j in range(i - i % 8, min(i - i % 8 + 8, len(level))) if j != i)
        i //= 8
    return out


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash int, idx int, n string, path int"


def _documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "3", None) for r in rows], DOCS)


def _expected(rows):
    """The contract's columns by rebuilding the whole tree for every changed leaf."""
    groups = {}
    for d, text, lang, source, n in rows:
        changed = None
        if d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            low = None if text is None else re.sub("[A-Z]", lambda m: m.group().lower(), text)
            changed = _leaf(d, source, lang, n, low)
        groups.setdefault(lang, []).append((d is not None, d or 0, _leaf(d, source, lang, n, text), d, changed))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda v: v[:3])
    subroots = [_root([v[2] for v in groups[x]]) for x in langs]
    root, out = _root(subroots), []
    for g, x in enumerate(langs):
        leaves = [v[2] for v in groups[x]]
        for i, (_, _, leaf, d, changed) in enumerate(groups[x]):
            folded = root
            if changed is not None:
                sub = _root([*leaves[:i], changed, *leaves[i + 1:]])
                folded = _root([*subroots[:g], sub, *subroots[g + 1:]])
            out.append((d, leaf, subroots[g], root, _h(_siblings(leaves, i) + _siblings(subroots, g)), folded))
    return out


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_equals_rebuilt_trees(spark, depth):
    r = random.Random(depth)
    rows = [(k if k % 50 else None, None if k % 31 == 0 else f"Text {k} ÄB", r.choice(["en"] * 8 + ["dé", "", "z"]),
             None if k % 7 else "s", k) for k in range(300)]
    rows += [rows[5], rows[5], (1000, "no capitals", None, None, None), (1001, "", "x", "", 0)]
    rows += [(2000 + k, "lone", f"l{k}", None, 1) for k in range(15)]  # more than one level of groups
    got = merkle.manifest(merkle.document_leaves(_documents(spark, rows)), depth=depth).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _expected(rows)))


def test_paths_lead_to_the_root(spark):
    rows = [(k, f"T{k}", "ab"[k % 2], None, k) for k in range(100)]
    for r in merkle.manifest(merkle.document_leaves(_documents(spark, rows)), with_paths=True).collect():
        path = [(p["before"].hex(), p["after"].hex()) for p in r["path"]]
        assert merkle.copied_path(r["leaf"], path)[-1] == r["root"]
        assert merkle.copied_path("0" * 64, path)[-1] != r["root"]
        assert _h("".join(b + a for b, a in path)) == r["proof_sha256"]


def test_manifest_of_one_and_of_none(spark):
    (r,) = merkle.manifest(merkle.document_leaves(_documents(spark, [(3, None, None, None, None)]))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == _h("")
    assert merkle.manifest(merkle.document_leaves(_documents(spark, []))).collect() == []


def test_versions_share_untouched_nodes():
    leaves = [_h(str(k)) for k in range(3000)]
    levels = merkle.block_levels(leaves, len(leaves))
    version = merkle.copied_path(_h("new"), merkle.siblings(levels, 1234))
    assert len(version) == merkle.levels_of(3000) == 4  # nothing but the ancestors is copied
    assert version[-1] == _root([*leaves[:1234], _h("new"), *leaves[1235:]]) and levels[-1][0] == _root(leaves)


# --- BPE ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(BPE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def _texts():
    r = random.Random(1)
    near = "aeinrst .,'\n\t  éß日本🙂0123xX\x1c\x85\xa0"
    for k in range(3000):
        if k % 3:
            t = "".join(r.choice(near) for _ in range(r.randrange(60)))
        else:
            t = "".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0x3000), r.randrange(0x1F300, 0x1F700),
                                      0x558, 0x209E, 0xA7F1])) for _ in range(r.randrange(40)))
        yield t + ("<|endoftext|> a<|endoftext|>" if k % 20 == 0 else "")
    yield from ("", " ", "x" * 30_000, "ab" * 10_000, " " * 9_000, "\n" * 3000 + "a", "=-" * 4000, prose(3000, 2))


def test_ids_and_texts_equal_the_library(coder, library):
    for t in _texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = coder.encode(t)
        assert got.tolist() == ids and coder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself(coder):
    assert all(coder.encode_word(w) == [i] for i, w in enumerate(coder.words) if i not in coder.added.values())


def test_decoding_any_ids(coder, library):
    r = random.Random(2)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randrange(30))]
        assert coder.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def _merge_by_rank(coder, word):
    """BPE by its definition: the merge of lowest rank, leftmost first, until none is left."""
    ids = [coder.words.index(c) for c in word]
    while True:
        found = [(coder.rank[coder.merged[p]], k) for k, p in enumerate(zip(ids, ids[1:])) if p in coder.merged]
        if not found:
            return ids
        k = min(found)[1]
        ids[k:k + 2] = [coder.merged[ids[k], ids[k + 1]]]


def test_words_equal_merging_by_rank(coder):
    r = random.Random(4)
    alphabet = list(bpe.byte_alphabet())
    for k in range(400):
        letters = alphabet if k % 4 == 0 else "aeinrstlohĠ" if k % 4 < 3 else "ab"
        word = "".join(r.choice(letters) for _ in range(r.randrange(1, 25)))
        assert coder.encode_word(word) == _merge_by_rank(coder, word)


def test_long_words_take_linear_time(coder):
    steps = []
    for n in (20_000, 80_000):
        calls = 0

        def counted(a, b, known=coder.compatible):
            nonlocal calls
            calls += 1
            return known(a, b)

        coder.compatible = counted
        try:
            coder.encode_word("".join(words(n // 4, 3, 60))[:n])
        finally:
            del coder.compatible
        steps.append(calls)
    assert steps[1] < 5 * steps[0]


def test_documents_come_back(spark, make_docs, nasty, library):
    rows = bpe.encode_documents(make_docs(nasty), BPE).collect()
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"]).decode()) for r in rows)
    want = sorted((str(d), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "")
                  for d, t in nasty)
    assert got == want
    assert bpe.encode_documents(make_docs([]), BPE).collect() == []


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        bpe.BytePairs(public_tokenizers.path("word_bpe_49k.json"))


def test_word_bigrams_are_counted_and_weighed(spark):
    """The same words in another order weigh as their bigrams do."""
    from assaylake.llm import importance
    good, bad = b"alpha beta gamma delta", b"beta alpha delta gamma"
    table = importance._Table()
    table.add([importance.ngrams(t) for t in [good] * 300 + [bad] * 300 + [b"", b"alpha alpha alpha"]],
              np.arange(602) < 300)
    table.forget()
    pairs = table.counts[:, sum(importance.SPACES):]
    assert pairs.sum(axis=1).tolist() == [600 * 3 + 2, 300 * 3]  # none over the ends of texts, none with a mark
    h = importance._hashes([b"beta", b"alpha"])
    assert table.counts[:, importance.pair_buckets(h[:1], h[1:])[0]].tolist() == [300, 0]
    scores = importance._Scores(importance.log_ratios(*table.counts))
    up, down, none = importance.log_weights([good, bad, b""], scores)
    assert up == 0 and down < -1 and none == 0
