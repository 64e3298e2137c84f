"""The operators against brute force, exact round trips, planted cases and held-out labels."""

import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from llm_texts import prose, words

import corpus_pipeline
from assaylake.llm import (components, html_blocks, importance, licenses, line_chunks, line_rules, pieces, simhash,
                           spans, tiling, token_files)

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _union(n, pairs):
    parent = {i: i for i in n}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in n}


# --- HTML ---------------------------------------------------------------

def test_tree_tells_the_labelled_blocks_apart():
    tree = html_blocks.train_tree(html_blocks.LABELLED)
    assert all(html_blocks.is_main(tree, r[:-1]) == bool(r[-1]) for r in html_blocks.LABELLED)


def test_pages_against_their_markup(spark):
    got = {r["page_id"]: r for r in html_blocks.op1_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_page_parts_that_are_not_main_text(spark):
    page = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home"><header><p>Site name'
            '</p></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies to show you this site.'
            '</div><main><article><h1>Head &amp;amp; line</h1><p>First <b>bold</b>\n text&nbsp;here.<p>Second, unclosed'
            '<br>with a break &lt;tag&gt;<script>if(a<b){"</p>"}</script><ul><li>item one here</ul><!-- <p>no</p> -->'
            '<p hidden>secret</p><form><label>Mail</label><input></form><div class="ad-slot">Buy now</div>'
            '<section id="comments"><p>I liked this text very much, thank you.</p></section><pre>a  b\n c</pre>'
            '</article></main><aside><p>Related things to read that are long enough to look like text.</p></aside>'
            '<footer>Footer words</footer></body></html>')
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "no markup " * 20),
                                  (4, "x", "<p>a<"), (4, "x", "<article><p>x <a <b>y</p>")],
                                 "page_id long, url string, html string")
    got = html_blocks.extract_main(rows).collect()
    assert got[0]["text"] == ("Head &amp; line\n\nFirst bold text here.\n\nSecond, unclosed with a break <tag>\n\n"
                              "item one here\n\na b c")
    assert [g["text"] for g in got[1:3]] == ["", ""] and got[3]["text"] == ("no markup " * 20).strip()
    assert [g["page_id"] for g in got] == [1, 2, None, 3, 4, 4]


# --- Spans and line chunks ----------------------------------------------

def _brute_spans(docs):
    parts = {k: [(s, s.lower().split()) for s in spans.sentences(t.encode())] for k, t in docs}
    seen, gone = defaultdict(list), defaultdict(set)
    for k, ss in parts.items():
        found = set()
        for i in range(len(ss)):
            for step, stop in ((1, len(ss)), (-1, -1)):
                n = 0
                for j in range(i, stop, step):
                    n += len(ss[j][1])
                    if abs(j - i) + 1 >= spans.MIN_SENTENCES and n >= spans.MIN_WORDS:
                        found.add((min(i, j), max(i, j)))
                        break
        for i, j in found:
            seen[tuple(b" ".join(w) for _, w in ss[i:j + 1])].append((k, i, j))
    for places in seen.values():
        for k, i, j in sorted(places)[1:]:
            gone[k].update(range(i, j + 1))
    out = {}
    for k, ss in parts.items():
        t = b"".join(s for i, (s, _) in enumerate(ss) if i not in gone[k])
        out[k] = (t.rstrip(b" \t\n\r\v\f") if gone[k] else t).decode()
    return out


def test_spans_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _brute_spans([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["text"] for r in spans.op2_substring_dedup(spark, SF).collect()}
    assert got == want and any(got[r["doc_id"]] != r["text"] for r in docs.collect())


def test_a_repeated_passage_goes_whole(spark, make_docs):
    passage = prose(60, 99)
    texts = [(i, prose(80, 100 + i) + ("\n" + passage + "\n" if i % 2 else "\n") + prose(70, 200 + i)) for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(make_docs(texts)).collect()}
    assert got[1] == texts[1][1]
    for i, t in texts:
        assert got[i] == (t if i % 2 == 0 or i == 1 else t.replace(passage + "\n", ""))


def test_passages_without_sentence_marks_are_found(spark):
    docs = {}
    for k, n in enumerate([51, 51, 60, 80, 200] * 8):
        passage = words(n, 7000 + k)
        if k % 4 == 1:
            passage[26] += "."
        if k % 4 == 2:
            passage[12] += "!"
            passage[n - 13] += "."
        for d in (0, 1):
            a, z = (words(5 + (k * 11 + d * 17) % 40, 9000 + 4 * k + 2 * d + i) for i in (0, 1))
            docs[2 * k + d] = " ".join([*a, *passage, *z])
    docs[900] = docs[901] = " ".join(words(2320, 3))
    docs[902], docs[903] = " ".join(words(90, 4)), "Short text. " + " ".join(words(90, 5))
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(table).collect()}
    seen, repeated = set(), defaultdict(set)
    for d, t in sorted(docs.items()):  # brute force: words in some repeated run of MIN_WORDS words
        w = t.split()
        for i in range(len(w) - spans.MIN_WORDS + 1):
            if tuple(w[i:i + spans.MIN_WORDS]) in seen:
                repeated[d].update(range(i, i + spans.MIN_WORDS))
        seen |= {tuple(w[i:i + spans.MIN_WORDS]) for i in range(len(w) - spans.MIN_WORDS + 1)}
    for d, t in docs.items():
        if d not in repeated:
            assert got[d] == t
            continue
        w, stay = t.split(), got[d].split()
        assert len(w) - len(stay) >= len(repeated[d]) - 26 and len(w) - len(stay) <= len(repeated[d])
        assert stay == w[:(k := next((i for i, (x, y) in enumerate(zip(w, stay)) if x != y), len(stay)))] + w[len(w) - len(stay) + k:]
    assert len(repeated) == 41 and got[900] == docs[900] and got[901] == ""
    assert all(b"".join(spans.sentences(t.encode())) == t.encode() for t in docs.values())


def test_line_chunks_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    block = "\n".join(prose(12, i) for i in range(400, 420))
    docs |= {9001: "a b\n" + block + "\nc d", 9002: "e f\ng h\ni j\n" + block}
    seen, gone = defaultdict(list), defaultdict(set)
    for k, t in docs.items():
        for a, z, body in line_chunks.chunks(t.encode(), line_chunks.WINDOW, line_chunks.DIVISOR, line_chunks.MIN_LINES):
            seen[body].append((k, a, z))
    for places in seen.values():
        for k, a, z in sorted(places)[1:]:
            gone[k].update(range(a, z))
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs.items()}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(table).collect()}
    assert got == want
    assert got[9001] == docs[9001] and len(got[9002]) < len(docs[9002]) / 2  # boundaries meet again after the shift


def _copied_runs(docs, min_words):
    """Lines of every run of two lines with text that stands earlier too, with ``min_words`` words or more."""
    seen, gone = set(), defaultdict(set)
    for k, t in sorted(docs.items()):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        for a, z in zip(full, full[1:]):
            body = "\n".join(lines[a:z + 1])
            if body in seen and len(body.split()) >= min_words:
                gone[k].update(range(a, z + 1))
            seen.add(body)
    return gone


def test_line_chunks_find_every_run_of_two_lines(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for k, n in enumerate((2, 3, 4, 5, 8, 12, 20) * 6):
        gap = "\n\n" if k % 2 else "\n"
        block = gap.join(" ".join(words(30, 5000 + 40 * k + i)) for i in range(n))
        for d in (0, 1):
            around = ["\n".join(" ".join(words(9, 9 * x + 7)) for x in range(y, y + 3)) for y in (8000 + 7 * k + 3 * d, 600 * d + k)]
            docs[10_000 + 2 * k + d] = f"{around[0]}\n{block}\n{around[1]}"
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(table).collect()}
    copied = _copied_runs(docs, 50)
    assert sum(k >= 10_000 and k % 2 == 1 for k in copied) == 42
    for k, lines in copied.items():
        assert lines <= {i for c in got[k]["removed"] or () for i in range(c["a"], c["z"])}
    first = set()
    for k in sorted(docs):  # whatever went stands in an earlier place
        lines = docs[k].split("\n")
        gone = {i for c in got[k]["removed"] or () for i in range(c["a"], c["z"])}
        for i, x in enumerate(lines):
            assert i not in gone or not x.strip() or x in first
            first.add(x)


# --- SimHash and components ---------------------------------------------

def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    edges += [(5000, 5000 + i) for i in range(300)] + [(7, 7)]
    want = _union({x for e in edges for x in e}, edges)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def _slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = {k: _slow_fingerprint(t) for k, t in docs}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = _union(list(fps), near)
    got = {r["doc_id"]: r for r in simhash.op3_simhash(spark, SF).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    kept = {r["doc_id"] for r in simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert kept == set(want.values())


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for c in centres for _ in range(400)}
    fps |= {centres[0] ^ (x << 16) for x in range(500)} | {0, 1, 3, 7, (1 << 64) - 1}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    links = [(x["u"], x["v"]) for x in simhash.fingerprint_links(table).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    assert _union(signed, links) == _union(signed, near)


# --- Pieces -------------------------------------------------------------

def test_pieces_decode_to_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = pieces.encode_texts(docs, PIECES)
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_ids(coded, PIECES).collect()} == want
    again = pieces.encode_texts(docs.repartition(7), PIECES).collect()
    assert {r["doc_id"]: r["ids"] for r in again} == {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert all(r["lossless"] for r in again)


def test_pieces_are_drawn_by_weight():
    m = pieces.PieceModel(PIECES)

    def all_paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in m.pieces:
                i, w = m.pieces[s[:k]]
                for rest, p in all_paths(s[k:]):
                    yield (i, *rest), w * p
    want = dict(all_paths(" there"))
    total, n = sum(want.values()), 20_000
    got = Counter(tuple(x.tolist()) for x in m.sample(["there"] * n, np.arange(n, dtype=np.uint64)))
    assert set(got) <= set(want)
    for path, w in want.items():
        p = w / total
        assert abs(got[path] - n * p) < 5 * (n * p * (1 - p)) ** 0.5 + 5
    long = "".join(chr(97 + (i * i) % 26) for i in range(3000))  # filtered one by one, with rescaling
    assert m.decode(m.sample([long], np.array([3], np.uint64))[0].tolist()) == long


# --- Quality rules and licenses ------------------------------------------

def test_quality_rules_by_hand(spark, make_docs):
    good = "\n".join(prose(30, i) for i in range(3))
    menu = "\n".join(f"Home | About {i} | Contact {i}" for i in range(30))
    same = "one two three " * 40
    got = {r["doc_id"]: r for r in line_rules.clean_lines(make_docs(
        [(1, good), (2, good + "\n" + menu), (3, same), (4, "few words."), (5, good + "\nAll rights reserved.\n\n" + "x"),
         (6, None)])).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, False, False, False, True, False]
    assert [got[i]["base_failed"] for i in range(1, 7)] == [False, False, True, True, False, True]
    assert got[5]["text"] == good + "\n" and got[5]["lost_words"] == 4
    assert got[3]["n_repeat_words"] == 120 and got[2]["n_symbols"] == 60 and got[6]["n_words"] == 0


def test_repeat_words_against_brute_force():
    for seed in range(30):
        w = [x.encode() for x in words(80, seed, 5)]
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        want = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
        assert line_rules.repeat_words(w) == len(want)


def test_license_notices(spark, make_docs):
    t = {k: v.replace("{", "").replace("}", "") for k, v in licenses.TEMPLATES.items()}
    texts = [(i, f"{prose(40, i)}\n{notice}\n{prose(30, 90 + i)}") for i, notice in enumerate(t.values())]
    changed = t["MIT"].replace("free of charge, ", "").replace("merge, publish", "print")
    texts += [(1000, prose(500, 55)), (1001, f"{t['MIT-notice']} {t['Apache-2.0-notice']} {t['MIT-notice']}"), (1002, changed),
              (1003, " ".join(random.Random(1).sample(t["MIT"].split(), len(t["MIT"].split()))))]
    found = defaultdict(list)
    docs = dict(texts)
    for r in licenses.scan_licenses(make_docs(texts)).orderBy("doc_id", "start").collect():
        found[r["doc_id"]].append(r)
    for i, name in enumerate(t):
        assert [r["license"] for r in found[i]] == [name] and found[i][0]["coverage"] == 1.0
        assert docs[i][found[i][0]["start"]:found[i][0]["end"]].lower()[:5] == t[name].lower()[:5]
    assert [r["license"] for r in found[1001]] == ["MIT-notice", "Apache-2.0-notice", "MIT-notice"]
    assert found[1002][0]["license"] == "MIT" and 0.8 <= found[1002][0]["coverage"] < 1
    assert 1000 not in found and 1003 not in found


def test_longest_increasing_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        v = [r.randrange(12) for _ in range(r.randrange(12))]
        got = [v[i] for i in licenses.longest_increasing(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        assert len(got) == max(best, default=0) and got == sorted(set(got))


# --- Tiling -------------------------------------------------------------

def _slow_tiles(a, b, size):
    in_a, in_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in in_a and j + n not in in_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return out
        out.append((i, j, n))
        in_a.update(range(i, i + n))
        in_b.update(range(j, j + n))


def test_tiles_against_brute_force():
    r = random.Random(4)
    for _ in range(150):
        a, b = ([r.choice("abc") for _ in range(r.randrange(1, 26))] for _ in range(2))
        pairs = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i:i + 3] == b[j:j + 3]]
        assert sorted(tiling.greedy_tiles(pairs, 3)) == sorted(_slow_tiles(a, b, 3))


def test_reordered_passages_are_found(spark, make_docs):
    items = [(i, " ".join(words(40, 500 + i))) for i in range(5)]

    def shuffled(t):
        w = t.split()
        parts = [w[i:i + 8] for i in range(0, len(w), 8)]
        return " ".join(x.upper() for p in parts[::-1] for x in p)
    texts = [(1, prose(200, 1) + " " + shuffled(items[0][1]) + " " + prose(90, 2)), (2, prose(300, 3)),
             (3, items[1][1] + "\n" + items[2][1]), (4, " ".join(items[3][1].split()[:20])), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in tiling.contaminated(make_docs(texts), bench).collect()}
    assert set(got) == {1, 3}
    assert got[1]["item_id"] == 0 and got[1]["n_tiles"] == 5 and got[1]["coverage"] == 1.0
    assert got[3]["item_id"] == 1 and got[3]["n_items"] == 2
    half = tiling.contaminated(make_docs(texts), bench, min_coverage=0.5).where("doc_id = 4").collect()
    assert half[0]["coverage"] == 0.5


# --- Token files ---------------------------------------------------------

def test_elias_fano():
    r = random.Random(8)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (2000, 50), (3000, 10**9), (700, 700)):
        v = np.array(sorted(r.randrange(top + 1) for _ in range(n)), np.int64)
        e, at = token_files.EliasFano.from_bytes(b"xy" + token_files.EliasFano.of(v).to_bytes(), 2)
        for lo, hi in [(0, n), (n // 3, n // 2), (n, n), (max(n - 5, 0), n), (min(511, n), min(1025, n))]:
            assert e.select_range(lo, hi).tolist() == v[lo:hi].tolist()
        assert e.values().tolist() == v.tolist() == [e.select(i) for i in range(n)]
        if n:
            assert 8 * e.n_bytes() <= n * (3 + max(0, (int(v[-1]) // n).bit_length())) + 64


def test_token_shards_give_any_document(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, folder = Tokenizer.from_file(path), token_files.new_folder(spark, "test_tokens")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = {-5: "two  blanks", -4: "end ", -3: "a<|endoftext|>b", -2: "tab \t x\n\n y", -1: "nb sp  x\x1c y"}
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    texts |= odd
    manifest = token_files.write_token_files(docs, path, folder).orderBy("shard").collect()
    seen = 0
    for m in manifest:
        s = token_files.TokenShard(folder, m["path"])
        for i in range(s.n_docs):
            seen += 1
            assert s.ids(i).tolist() == tok.encode(texts[s.doc_id(i)], add_special_tokens=False).ids + [2]
    assert seen == len(texts)


# --- Classifier and pipeline ----------------------------------------------

def test_kth_largest_against_sorting(spark):
    r = random.Random(3)
    v = [r.choice([r.gauss(0, 1), r.gauss(0, 1e-3), 0.0, -5.5, 1e300]) for _ in range(500)]
    table = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    for k in (1, 2, 17, 250, 499, 500):
        assert importance.kth_largest(table, "x", k) == sorted(v, reverse=True)[k - 1]
    assert importance.kth_largest(table, "x", 501) is None


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 3 > 0")
    kept = importance.classify(docs, known).select("doc_id", "kept")
    rows = kept.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    toxic = [r["kept"] for r in rows if r["toxic"] == 1]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.1 and np.mean(toxic) < 0.35


def test_classifier_finds_toxic_words_of_each_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = importance.classify(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "lang", "kept")
    rows = kept.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    for lang in ("en", "fr", "de", "es"):
        toxic = [r["kept"] for r in rows if r["toxic"] == 1 and r["lang"] == lang]
        good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0 and r["lang"] == lang]
        print(lang, len(toxic), sum(toxic), len(good), sum(good))
        assert np.mean(toxic) < 0.4 and np.mean(good) > 0.9
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    print("junk", len(junk), sum(junk))
    assert np.mean(junk) < 0.1


def test_marks_of_repeated_words_count_once():
    rows = importance.buckets([importance._SAME, b"r\xc3\xa9\xc3\xaao", "réêoux".encode(), "réêout".encode()])
    assert rows.shape == (len(importance.SPACES), 4) and len(set(rows[0].tolist())) == 4
    assert rows[1, 1] == rows[1, 2] == rows[1, 3] and rows[2, 2] == rows[2, 3] and rows[3, 2] != rows[3, 3]
    raw = np.full(importance.TOTAL, 100)
    ratios = importance.log_ratios(raw, np.where(np.arange(len(raw)) % 7 == 0, 0, 50))
    assert (ratios[rows[1:, 0]] == 0).all()


def test_gumbel_top_k_draws_k(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert importance.classify(docs, labels, k=50).where("kept").count() == 50
    assert importance.keep_drawn(docs, labels, k=20).columns == docs.columns


def test_pipeline_runs_and_names_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup",
                                                      "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "lossless"] and 0 < out.count() <= 200
    assert out.where("not lossless").count() == 0


def test_spans_of_documents_are_read_without_the_whole_boundaries(spark, monkeypatch):
    docs = spark.createDataFrame([(None if k % 90 == 0 else k // 2, prose(k % 17, k)) for k in range(700)],
                                 "doc_id long, text string")
    folder = token_files.new_folder(spark, "test_spans")
    manifest = token_files.write_token_files(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), folder)
    path = manifest.first()["path"]
    whole = token_files.TokenShard(folder, path)
    ends, keys = whole.ends.values(), [None] * whole.n_null + (whole.keys.values() + whole.low).tolist()
    monkeypatch.setattr(token_files.EliasFano, "values", None)
    for lo in range(0, whole.n_docs, 64):
        hi = min(lo + 64, whole.n_docs)
        got_ends, got_keys = whole.span(lo, hi)
        assert got_ends.tolist() == ends[lo:hi].tolist() and got_keys == keys[lo:hi]
    rows = token_files.read_token_files(manifest, folder, span_docs=64).collect()
    assert sorted(r["start"] for r in rows)[0] == 0 and len(rows) == 700


def test_shared_bytes_against_brute_force():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in (0, 1))
    keep = r.integers(0, 256, 500)
    b = np.array([int.from_bytes(bytes(x if k >> i & 1 else y for i, (x, y) in enumerate(zip(
        int(p).to_bytes(8, "little"), int(q).to_bytes(8, "little")))), "little")
        for p, q, k in zip(a, b, keep)], np.uint64)
    want = [sum(x == y for x, y in zip(int(p).to_bytes(8, "little"), int(q).to_bytes(8, "little"))) for p, q in zip(a, b)]
    assert simhash.shared_bytes(a ^ b).tolist() == want


def test_columns_called_as_the_code_calls_its_own(spark):
    """Users' columns with the very names used inside come through with their values."""
    names = ["id", "hash", "c0", "c1", "may", "cut", "new", "row", "good", "bad_id", "bad_hash", "cut_id", "cut_hash",
             "__id", "__hash", "__rh", "__cut", "__row", "__good", "part", "block", "k", "h", "h2"]
    texts = [prose(60, 1), prose(60, 1) + " tail", prose(50, 2), prose(60, 3) + "\n" + prose(60, 1), None, ""]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(50, 2))], "item_id long, text string")
    outs = {"one": simhash.keep_one(docs), "spans": spans.dedup_spans(docs), "lines": line_chunks.dedup_lines(docs),
            "bench": tiling.drop_contaminated(docs, bench), "drawn": importance.keep_drawn(docs, labels)}
    for what, out in outs.items():
        got = out.collect()
        assert got and out.columns[:2] == ["doc_id", "text"], what
        for r in got:
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], what
    assert {r["doc_id"] for r in outs["bench"].collect()} == {0, 1, 3, 4, 5}


def test_short_items_are_searched(spark, make_docs):
    texts = [(1, "so the answer is forty two, they said"), (2, "the answer is forty  Two they said"), (3, prose(40, 1)),
             (4, "yes"), (5, "a b c"), (6, "a b x c")]
    bench = spark.createDataFrame([(1, "Forty two"), (2, "yes"), (3, "a b c"), (None, "forty two"), (4, " ")],
                                  "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_items"], r["coverage"]) for r in tiling.contaminated(make_docs(texts), bench).collect()}
    assert {k: v[1:] for k, v in got.items()} == {2: (2, 1.0), 4: (1, 1.0), 5: (1, 1.0)}


def test_pairs_that_cannot_reach_the_threshold_are_dropped_by_count(spark, make_docs):
    r = random.Random(8)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(4, 30)))) for i in range(12)]
    texts = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(0, 60)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = ["doc_id", "item_id"]
    every = {(x["doc_id"], x["item_id"]): x["covered"] / x["n_words"] for x in
             tiling.tile_coverage(make_docs(texts), bench).collect()}
    for least in (0.3, 0.6, 1.0):
        some = {(x["doc_id"], x["item_id"]): x["covered"] / x["n_words"] for x in
                tiling.tile_coverage(make_docs(texts), bench, least=least).collect()}
        assert some.items() <= every.items() and len(some) < len(every), key
        assert {k for k, v in every.items() if v >= least} <= set(some)


def test_content_defined_chunks_explain_most_removed_lines(spark):
    got = line_chunks.op10_line_dedup(spark, SF).agg({"n_lines_removed": "sum", "n_lines_in_chunks": "sum"}).first()
    assert 0 < got["sum(n_lines_removed)"] < 2 * got["sum(n_lines_in_chunks)"]
