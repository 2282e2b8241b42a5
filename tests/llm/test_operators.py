"""Operators against plain versions, and the cases that their docstrings define."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut
from ledgerline.llm import bpe, chat, exact_dedup, language, licenses, mixing, mtree, near_dedup, pii, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with a column whose name clashes with an output."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), True) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


ODD = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (5, "x" * 20000), (6, "x" * 20000), (6, "x" * 20000), (7, "  ")]


def test_exact_dedup_odd_rows(spark):
    for block in (4096, 7):
        got = exact_dedup.exact_dedup(docs(spark, ODD), block_bytes=block).collect()
        assert len(got) == len(ODD)
        kept = sorted((r.doc_id for r in got if r.kept), key=str)
        assert kept == [2, 4, 6, 7]
        assert {r.group_size for r in got if r.doc_id == 6} == {3} and sum(r.kept for r in got if r.doc_id == 6) == 1
        assert all(r.keep_id == 2 for r in got if r.doc_id in (1, None))
        assert next(r.text_sha256 for r in got if r.doc_id == 3) == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, ODD).filter("false")).count() == 0


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))], [len(s) for s in sets]


def test_near_dedup_is_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(4):
        text = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, "A b"), (103, "a\tB"), (None, rows[0][1]), (104, rows[0][1])]
    expected, sizes = brute_components(rows)
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    want = sorted(((d, n, c) for (d, _), n, c in zip(rows, sizes, expected, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert near_dedup.near_dedup(docs(spark, rows).filter("false")).count() == 0


def test_block_links_are_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 10**6, 100)
    sets = [np.unique(np.concatenate([base[: rng.integers(80, 100)], rng.integers(0, 10**6, rng.integers(0, 8))])) for _ in range(40)]
    nodes = np.arange(40)
    found = near_dedup.block_links(nodes, nodes, sets, 85)
    label = list(range(40))
    for a, b in found:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    for i in range(40):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                assert label[i] == label[j]


def test_signature_is_circulant():
    sh = np.array([5, 10**12, 77], np.uint64)
    sig = near_dedup.signature(sh)
    pi = np.random.default_rng(20).permutation(near_dedup.PLACES)
    sigma = (sh * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x632BE5AB)) & np.uint64(near_dedup.PLACES - 1)
    assert all(sig[k] == min(pi[(int(s) + k) % near_dedup.PLACES] for s in sigma) for k in range(len(sig)))


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
    whole = near_dedup.shingle_sets_of([text])[0]
    monkeypatch.setattr(words, "SLICE", 500)
    assert np.array_equal(near_dedup.shingle_sets_of([text])[0], whole)


def test_mixing_near_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(900, None), (901, "")]
    got = mixing.mix(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6
    for (size, target), rs in by.items():
        assert target <= 3 * size + 1e-9 and abs(sum(r.taken for r in rs) - target) <= 40
        assert all(r.taken <= 3 * r.size for r in rs)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=str)
    times = {r.doc_id: r.repeats for r in got}
    applied = {r.doc_id: r["count"] for r in mixing.apply_mix(docs(spark, rows)).groupBy("doc_id").count().collect()}
    assert applied == {d: n for d, n in times.items() if n}
    assert mixing.mix(docs(spark, rows).filter("false")).count() == 0


def test_bpe_agrees_with_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\t", "12", "é", "ß", "%%", "<|endoftext|>", " ", "　", "中", "😀", "'s", "\x1c", "\x85", "½"]
    shared = "".join(rng.choice(parts) for _ in range(5000))
    rows = [(i, shared[rng.randrange(4000) :] + "".join(rng.choice(parts) for _ in range(50)) + shared) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "x" * 30000), (53, shared), (53, shared)]
    frame = docs(spark, rows)
    texts = cut(frame.select(F.col("doc_id").cast("string").cast("binary").alias("key"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    found, holders = bpe.shared_chunks(texts)
    entries = bpe.encode_chunks(texts, found, spark.sparkContext.broadcast(bpe.default_files()))
    assert entries.count() == entries.select("hash").distinct().count() > 1 and holders.filter("several").count() > 12
    for r in bpe.digest_documents(frame).collect():
        text = next(x for d, x in rows if d == r.doc_id) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(frame).select("doc_id", "ids")).collect()
    assert all(b.text == (next(x for d, x in rows if d == b.doc_id) or "") for b in back)


def test_toxicity_learns(spark):
    rng = random.Random(5)
    say = lambda bad: " ".join(rng.choice(["sun", "tree", "river", "stone", "cloud"]) for _ in range(30)) + (" you vile wretch" if bad else "")
    rows = [(i, say(i % 4 == 0)) for i in range(400)] + [(1000, None), (1001, ""), (None, "sun")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400) if got[i].held_out)
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score and got[None].held_out
    assert toxicity.drop_toxic(docs(spark, rows), labels).count() == 303
    bare = toxicity.score_documents(docs(spark, rows[:3]), labels.filter("false")).collect()
    assert {r.score for r in bare} == {0.5}


def test_language(spark):
    rows = [(i, f"der und die nicht {i} schön", "de") for i in range(60)] + [(100 + i, f"the and of with {i} thing", "en") for i in range(60)]
    got = {r.doc_id: r for r in language.identify(docs(spark, [*rows, (500, None, None), (501, "123 !!"), (502, "")])).collect()}
    assert all(got[d].lang_pred == x for d, _, x in rows) and all(got[d].lang_pred == "und" for d in (500, 501, 502))
    assert {r.lang_pred for r in language.identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(700)]
    vectors += [(800 + i, [0.5] * 8, 0) for i in range(60)] + [(900, None, 0), (901, [float("nan")] * 8, 0), (950, [None] * 8, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int")
    m = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v, _ in vectors if v and v[0] is not None and v[0] == v[0]}
    expected = {(q, k + 1, i, s) for q in m if q % 50 == 0 for k, (s, i) in enumerate(sorted(((-int(m[q] @ m[i]), i) for i in m if i != q))[:5]) for s in [-s]}
    assert {tuple(r) for r in mtree.top_k(df, page=100, pivots=4).collect()} == expected
    assert mtree.top_k(df.filter("false")).count() == 0
    assert mtree.top_k(df.filter("vec_id in (0, 1)")).count() == 1


def plain_spans(text):
    """The base patterns as they are stated, one by one."""
    stated = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in stated.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_zeros_of_any_length(spark):
    zeros = "0" * 6000
    texts = [f"{zeros}.1.1.1", f"{zeros}1.2.3.4", f"1.2.3.{zeros}255", f"1.2.3.{zeros}256", "0.0.0.0"]
    assert [len(pii.base_spans(t)) for t in texts] == [1, 1, 1, 0, 1]


def test_pii_paths_are_the_best_of_all_and_their_probabilities_true():
    rng = np.random.default_rng(2)
    net = pii.Tagger(seed=5)
    net.p["trans"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    net.p["bias"] = rng.standard_normal(pii.TAGS).astype(np.float32)
    x = rng.integers(32, 127, (3, 4)).astype(np.uint8)
    x[2, 3] = pii.PAD
    tags, e = net.viterbi(x)
    prob = net.marginals(x, e, tags)
    trans = net.p["trans"] + pii._ALLOWED
    for r in range(3):
        n = 4 - (r == 2)
        paths = np.array(np.meshgrid(*[range(pii.TAGS)] * n, indexing="ij")).reshape(n, -1)
        score = sum(e[t, r, paths[t]] for t in range(n)) + sum(trans[paths[t - 1], paths[t]] for t in range(1, n))
        assert tuple(tags[r, :n]) == tuple(paths[:, score.argmax()])
        weight = np.exp(score - score.max())
        for t in range(n):
            assert abs(weight[paths[t] == tags[r, t]].sum() / weight.sum() - prob[r, t]) < 1e-4


def test_pii_windows_of_many_texts_are_read_together():
    rng = random.Random(6)
    net = pii.Tagger(pii.train([f"call +49 171 {i:07d} or mail a{i}@b.org now, ip 10.0.{i}.1 " * 3 for i in range(60)], steps=40, windows=400))
    texts = ["", "no signal", *(f"x{rng.random()} call 171.555.{i:04d} a{i} at b dot org " * rng.randint(1, 40) for i in range(30))]
    assert pii.spans_of(texts, net) == [pii.all_spans(t, net) for t in texts]


def test_bpe_encodes_a_chunk_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "cut", lambda df: df)
    texts = spark.createDataFrame([("a", "some words " * 400), ("b", "some words " * 400)], "key string, text string")
    shared = spark.createDataFrame([(b"h", 2, "a", True)], "hash binary, n long, owner string, several boolean")
    plan = bpe.encode_chunks(texts, shared, bpe._sent(spark, None))._jdf.queryExecution().executedPlan().toString()
    encoding, picking = plan.split("REPARTITION_BY_COL")
    # the tasks that pick chunks do not encode them
    assert encoding.count("ArrowEvalPython") == picking.count("ArrowEvalPython") == 1


def test_bpe_broadcasts_plain_values(spark):
    sent = bpe._sent(spark, bpe.Files("a", b"b", "c")).value
    assert type(sent) is tuple and sent == ("a", b"b", "c")


def test_pii_spans(spark):
    rng = random.Random(4)
    text = "mail a.b@c.example.com, 10.0.0.256 10.0.0.25 4111 1111 1111 1111 call +1 (222) 333-4444 é"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "a.b@c.example.com"), ("ip", "10.0.0.25"), ("phone", "+1 (222) 333-4444")]  # "25 4111 ..." is one run of digits
    parts = ["a", ".", "@", "1", "23", "-", "+", "4111 1111 1111 1111", " ", "%", "(", "a@b.co", "1.2.3.4", "é"]
    odd = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(3000)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in [text, *odd])
    assert pii.base_spans(None) == [] and pii.base_spans("") == []
    for giant in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" + " " * 300_000):  # linear in the text
        assert len(pii.base_spans(giant)) in (0, 37_500)
    rows = [(1, text), (2, None), (3, "none"), (None, text), (1, text), (4, odd[0] * 500)]
    net = pii.train([f"word {i} write user{i}@mail.example.com now or +1 (212) 555-{i:04d}" for i in range(40)], steps=4)
    got = pii.digest(pii.find_spans(docs(spark, rows), net=net)).collect()
    assert len(got) == 6
    for r in got:
        base = plain_spans(next(t for d, t in rows if d == r.doc_id))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) and r.n_spans >= len(base)
    assert pii.find_spans(docs(spark, rows).filter("false"), net=net).count() == 0


def test_pii_network_finds_what_the_patterns_miss():
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(rng.choice(["sun", "tree", "river", "stone", "at", "no", "of"]) for _ in range(n))

    def text():
        mail = f"{rng.choice(['ann', 'bob', 'eve'])}.{rng.integers(99)}@mail{rng.integers(9)}.example.com"
        ip = ".".join(str(rng.integers(1, 255)) for _ in range(4))
        return f"{say(15)} {mail} {say(15)} {ip} {say(15)} +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} {say(9)} {rng.integers(10**9)}"

    net = pii.Tagger(pii.train([text() for _ in range(150)], steps=220))
    found = total = 0
    for _ in range(30):
        t, placed = pii.disguised(x := text(), pii.base_spans(x), rng)
        base, spans = pii.all_spans(t, net)
        assert pii.all_spans(t, net, skip_bare_windows=False) == (base, spans)
        total += len(placed)
        found += sum(any(k == kk and a < bb and aa < b for kk, aa, bb in set(spans) - set(base)) for k, a, b in placed)
    assert total == 90 and found > 70


def test_pii_gradients():
    net = pii.Tagger(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = "to a1@b.co or +1 (222) 333-4444 12"
    x = pii._window(pii.classes(t), 0)[None]
    y = np.pad(pii._label(len(t), pii.base_spans(t)), (0, pii.WINDOW - len(t)))[None]
    g = net.gradients(x, y)[1]
    for k, v in g.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        net.p[k][at] += 1e-3
        up = net.gradients(x, y)[0]
        net.p[k][at] -= 2e-3
        down = net.gradients(x, y)[0]
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - v[at]) < 1e-3 * max(1, abs(v[at]))


def test_chat_segments_agree_with_one_pass(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for c in range(80):
        for t in range(rng.randrange(2, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, ("q " * 5 if role == "user" else "answer words " * 40) + ("?" if role == "user" else "")))
    df = spark.createDataFrame([*rows, (None, 0, "user", "x"), (5, None, "user", None)], "conv_id long, turn long, role string, text string")
    model = chat.fit(df)
    whole = {(r.conv_id, r.turn): r.role_pred for r in chat.format_chats(df, model).collect()}
    assert all(whole[c, t] == role for c, t, role, _ in rows)
    monkeypatch.setattr(chat, "SEGMENT", 2)
    assert {(r.conv_id, r.turn): r.role_pred for r in chat.format_chats(df, model).collect()} == whole
    assert chat.format_chats(df.filter("false"), model).count() == 0


def test_licenses(spark):
    plain = [(i, f"some words about number {i}\nand more of them") for i in range(50)]
    rows = [*plain, (100, "text\nReleased under the MIT License."), (101, None), (102, ""), (103, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[100].licenses == "mit" and got[103].licenses == "gpl-3.0" and got[101].n_paragraphs == 0
    assert all(got[i].licenses == "" for i in range(50))


def test_pipeline_keeps_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"w{i} a b c d e f g h i{i}", "en", "s") for i in range(20)] + [(30, "w1 a b c d e f g h i1", "en", "s"), (30, "other words of this row", "en", "s")]
    frame = docs(spark, rows)
    kept = pipeline.drop_copies(spark, frame, "")
    assert kept.columns == frame.columns and kept.count() == 21
    assert {r.doc_id for r in kept.filter(F.col("text").startswith("w1 ")).collect()} == {30}
    near = pipeline.drop_near_copies(spark, kept, "")
    assert near.columns == frame.columns and near.count() == 21


def test_pipeline_drops_near_copies_from_80_per_cent(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = [f"w{i}" for i in range(54)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:20], "other", *text[21:]])), (3, " ".join([*text[:10], "x", *text[11:30], "y", *text[31:]]))]
    frame = docs(spark, rows)  # 45 of 55 shingles agree, then 40 of 60
    assert {r.doc_id for r in pipeline.drop_near_copies(spark, frame, "").collect()} == {1, 3}
    assert all(r.kept for r in near_dedup.near_dedup(frame).collect())


def test_giant_words_and_white_space_are_cut_without_loss(monkeypatch):
    giant = [c * 700 for c in "abcdefgh"]
    texts = [f"{giant[0]} x", f"{giant[0]} y", " ".join(giant[:2]), " ".join(giant[:4]), " ".join(giant[:6]), "p q" + " " * 1800 + "r s t u v",
             " " * 1800 + " ".join(giant[:4]) + " " * 900, " " * 1800 + " ".join(giant) + " z" * 600 + " " * 1800, " " * 1800, "a b c " + giant[2] + " d"]
    whole = near_dedup.shingle_sets_of(texts)
    assert [len(s) for s in whole] == [1, 1, 1, 1, 2, 3, 1, 9, 0, 1]
    monkeypatch.setattr(words, "SLICE", 500)
    for cut, full in zip(near_dedup.shingle_sets_of(texts), whole, strict=True):
        assert np.array_equal(cut, full)
    assert not np.array_equal(*near_dedup.shingle_sets_of(texts[:2]))


def test_top_k_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(1 + i, [float(x) for x in rng.standard_normal(8)]) for i in range(40)]
    rows += [(50, [2.0] * 8)] * 10 + [(100, [float(x) for x in rng.standard_normal(8)]) for _ in range(2)] + [(7, [1.0] * 8)] * 2
    m = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows]
    expected = []
    for q in (50, 100):
        pairs = sorted((-int(a @ b), j) for i, a in m for j, b in m if i == q and j != q)
        expected += [(q, n + 1, j, -s) for n, (s, j) in enumerate(pairs[:5])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    # each row of the query finds the same five rows of a leaf
    v = np.stack([b for _, b in m])
    tree = mtree.build_tree(np.array([i for i, _ in m]), v, float((v * v).sum(1).max()))
    best = sorted(((int(b @ m[40][1]), j) for j, b in m if j != 50), key=lambda x: (-x[0], x[1]))[:5]
    assert sorted(mtree.search_tree(tree, 50, m[40][1], 5)[0]) == sorted(best)


def test_pii_spans_without_signal_change_nothing():
    text = "call me at home on 555 12345 or later"
    bare = ("phone", 5, 17, 0.99)
    for sure, want in ((0.95, [("phone", 16, 28)]), (0.8, [])):  # it neither lengthens a span nor makes it surer
        own = ("phone", 16, 28, sure)
        assert pii.reconcile(text, [], [own]) == pii.reconcile(text, [], [bare, own]) == want


def test_licenses_wrapped_and_versions(spark):
    import textwrap

    plain = [(i, f"some words about number {i}\nand more of them") for i in range(50)]
    long = {k: ts[-1] for k, ts in licenses.TEMPLATES.items() if len(ts[-1]) > 100}
    rows = [(100 + n, "A file of ours.\n\n# " + "\n# ".join(textwrap.wrap(f"Copyright of us. {t}, and so on.", w)) + "\n\nThe end.")
            for w in (40, 70, 80) for t in long.values() for n in [len(t) * 100 + w]]
    wanted = {100 + len(t) * 100 + w: k for w in (40, 70, 80) for k, t in long.items()}
    other = {
        1: ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "apache-2.0,mit"),
        2: ("This work is licensed under the GNU General Public License, version 2.", ""),
        3: ("This work is licensed under the GNU Affero General Public License, version 3.", ""),
        4: ("Licensed under the Apache License, Version 1.1.", ""),
        5: ("This library is licensed under the GNU Lesser General Public License.", "lgpl"),
        6: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        7: ("Licensed under CC BY 4.0.", "cc-by"),
        8: ("This work is licensed under the GNU General\nPublic License, version 3.", "gpl-3.0"),
    }
    rows += [(10**6 + n, t) for n, (t, _) in other.items()]
    wanted |= {10**6 + n: k for n, (_, k) in other.items()}
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, [*plain, *rows])).collect()}
    assert {d: got[d] for d in wanted} == wanted and all(got[i] == "" for i in range(50))


def test_chat_of_a_turn_number_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 8)
    rows = [(1, 5, "user", f"User: question {i:03d}?") for i in range(150)] + [(1, 6, "assistant", f"Assistant: answer {i:03d}.") for i in range(150)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{('User', 'Assistant')[t % 2]}: line {c} {t}") for c in range(2, 30) for t in range(6)]
    frame = spark.createDataFrame([(c, t, r, x) for c, t, r, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    sizes = []

    def ranked(df, *rest, f=chat.rank_within):
        out = cut(f(df, *rest))
        sizes.append(out.groupBy("c", "alone", F.floor((F.col("at") - 1) / 8)).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(chat, "rank_within", ranked)
    got = chat.format_chats(frame).collect()
    assert sizes == [8] and len(got) == len(rows)
    assert sorted((r.conv_id, r.turn, r.role_pred) for r in got if r.conv_id > 1) == sorted((c, t, r) for c, t, r, _ in rows if c > 1)


UNKNOWN = [f"{a} {b} of the {c} is under {d} and {a} may be used by the {b} for {c}" for a in ("river", "house", "market") for b in ("people", "version", "public") for c in ("town", "work", "software") for d in ("terms", "water", "use")]


def test_licenses_windows_are_all_that_can_be_confirmed():
    rng = random.Random(8)
    pool = [w for ts in licenses.TEMPLATES.values() for x in ts for w in x.split()] + ["river", "house", "and."]
    for _ in range(60):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) if rng.random() < 0.85 else "" for _ in range(12)]
        lines.insert(rng.randrange(12), rng.choice(rng.choice(list(licenses.TEMPLATES.values()))))
        text = "\n".join(lines)
        parts, got = licenses.sentences(text), {(i, j) for i, j, _ in licenses.windows(text)}
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                words = b" ".join(b" ".join(p[2]) for p in parts[i:j])
                short = sum(len(p[2]) for p in parts[i : j - 1]) < licenses._LONGEST
                starts = any(w in licenses._WORDS for w in parts[i][2]) and any(w in licenses._WORDS for w in parts[j - 1][2])
                if short and starts and parts[i][1] == parts[j - 1][1] and any(licenses.confirmed(k, words) for k in licenses.TEMPLATES):
                    assert (i, j) in got


def test_licenses_the_classifier_names_the_family(spark):
    model = licenses.train(UNKNOWN)
    templates = [(k, x) for k, ts in licenses.TEMPLATES.items() for x in ts]
    read = licenses.classify(model, [x for _, x in templates])
    assert [f for f, _ in read] == [k for k, _ in templates]
    # of other paragraphs than those it has learned from, next to none pass the calibrated threshold
    rng = random.Random(9)
    pool = [*{w for u in UNKNOWN for w in u.split()}, *(w for ts in licenses.TEMPLATES.values() for x in ts for w in x.split()[:3]), *(f"word{i}" for i in range(60))]
    some = lambda n: [" ".join(rng.choice(pool) for _ in range(rng.randint(3, 25))) for _ in range(n)]
    assert sum(f != "unknown" for f, _ in licenses.classify(licenses.train(some(1000)), some(1000))) <= 10
    rows = docs(spark, [(n, x) for n, (_, x) in enumerate(templates)])
    right = {r.doc_id: r.licenses for r in licenses.scan(rows, model).collect()}
    assert right == {n: k for n, (k, _) in enumerate(templates)}
    turned = licenses.LicenseModel(model.features, model.weights[:, [0, *range(2, len(licenses.FAMILIES)), 1]], model.bias[[0, *range(2, len(licenses.FAMILIES)), 1]], model.threshold)
    assert not any(r.licenses for r in licenses.scan(rows, turned).collect())


def test_chat_parses_whole_transcripts(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"User: is it {c}?" if t % 2 == 0 else f"Assistant: it is.\nReally so, {c}\n\nand more of it")
            for c in range(40) for t in range(4)]
    text = "System: be kind\nUser: Hello there\nwhat is two?\nAssistant: It is two.\n\nNot three.\nUser: thanks"
    df = spark.createDataFrame([*rows, (100, 0, None, text), (None, 0, None, text), (101, 0, None, "\n".join([text] * 3))], "conv_id long, turn long, role string, text string")
    want = [("system", "be kind"), ("user", "Hello there\nwhat is two?"), ("assistant", "It is two.\n\nNot three."), ("user", "thanks")]
    want = [(r, f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in want]
    for model in (None, chat.fit(df.filter("false"))):
        for segment in (256, 2):
            monkeypatch.setattr(chat, "SEGMENT", segment)
            got = chat.format_chats(df, model).orderBy("conv_id", "turn", "part").collect()
            for c, times in ((100, 1), (None, 1), (101, 3)):
                assert [(r.role_pred, r.rendered) for r in got if r.conv_id == c] == want * times
            assert [(r.conv_id, r.turn, r.role_pred) for r in got if r.conv_id is not None and r.conv_id < 100] == [r[:3] for r in rows]


def test_top_k_of_uneven_and_huge_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(4 if i % 3 else 6)]) for i in range(1, 160)]
    rows += [(300, [1e300] * 4), (301, [1e300] * 6), (302, []), (350, []), (400, [9e5] * 4), (401, [-9e5, 9e5, 9e5, 1.0]), (402, [9e5, 3.0, 1e-3, 0.0])]
    rows += [(500, [1e7, -2e7, 0.0, 1.0]), (501, [-1e300, 1e300, 0.0, 0.0]), (502, [float("inf"), 0.0, 0.0, 0.0])]
    held = lambda x: max(min(x, 2**63 - 1), -(2**63))
    m = {i: [int(np.clip(np.floor(256 * x), -mtree.LARGEST, mtree.LARGEST)) for x in v] for i, v in rows if i != 502}
    expected = set()
    for q in (i for i in m if i % 50 == 0):
        best = sorted((-held(sum(a * b for a, b in zip(m[q], m[i], strict=True))), i) for i in m if i != q and len(m[i]) == len(m[q]))[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in mtree.top_k(df, page=20, pivots=3).collect()} == expected


def test_pages_stay_bounded_where_rows_share_an_id(spark):
    rows = spark.createDataFrame([(50, [1.0, 2.0])] * 900 + [(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    sizes = mtree._pages(cut(mtree.quantized(rows)), 2, 100).groupBy("page").count().agg({"count": "max"}).first()[0]
    assert sizes < 200


def test_ftrl_is_the_plain_recursion():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * 4 for _ in range(12)) for _ in range(30)]
    labels = [int("aaaa bbbb" in t) for t in texts]
    rows = toxicity.text_features(texts)
    model = toxicity.train(rows, labels, l1=0.3, updates=90)
    seen = {}
    for f in rows:
        for x in f.tolist():
            seen[x] = seen.get(x, 0) + 1
    z, n = {}, {}

    def weight(i):
        lam = 0.0 if i == "bias" else 0.3
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= lam else -(v - (lam if v > 0 else -lam)) / ((1.0 + n.get(i, 0.0) ** 0.5) / 1.0 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(30):
            at = [*(x for x in rows[k].tolist() if seen[x] > 1), "bias"]
            p = 1 / (1 + np.exp(-sum(map(weight, at))))
            g = p - labels[k]
            for i in at:
                w, before = weight(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) * w
                n[i] = before + g * g
    want = {i: weight(i) for i in z if weight(i) and i != "bias"}
    got = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-4 for i in want) and abs(model.bias - weight("bias")) < 1e-9
    own = [sum(got.get(x, 0.0) for x in f.tolist()) + model.bias for f in rows]
    assert np.allclose(toxicity.score_texts(model, texts), 1 / (1 + np.exp(-np.array(own))))


def test_toxicity_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "kind sun " * 20 if i % 2 == 0 else "vile mud " * 20) for i in range(40)] + [(90, "sun river " * 200_000), (91, "x" * 100_000), (91, "x" * 100_000)]
    got = toxicity.score_documents(docs(spark, rows), labels).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs(spark, rows).filter("false"), labels).count() == 0
    assert toxicity.drop_toxic(docs(spark, rows), labels.filter("false")).count() == 43
    few = toxicity.sample_features(docs(spark, rows), labels, max_features=3000)
    assert few.count() > 0 and few.agg(F.sum(F.length("f"))).first()[0] <= 12_000


def test_language_is_the_plain_average(spark):
    rows = [(i, f"der und die nicht {i} schön", "de") for i in range(60)] + [(100 + i, f"the and of with {i} thing", "en") for i in range(60)]
    frame = docs(spark, [*rows, (300, "und the " * 30_000, None), (300, "und the " * 30_000, None)])
    m = language.fit(frame)
    for r in language.identify(frame, m).collect():
        text = next(t for d, t, _ in [*rows, (300, "und the " * 30_000, None)] if d == r.doc_id).encode().lower()
        grams = [h for n in (2, 3, 4) for h in language._buckets(np.frombuffer(text, np.uint8).astype(np.uint32), n).tolist()]
        z = (np.mean(m.embeddings[grams], axis=0, dtype=np.float64) @ m.layer + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == m.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-5 and r.rejected == (r.score < m.threshold)
    assert language.identify(frame.filter("false"), m).count() == 0


def test_chat_is_the_best_of_all_paths(spark, monkeypatch):
    import itertools

    rng = random.Random(12)
    line = lambda: rng.choice(["User: hello?", "Assistant: yes it is so", "and more of it", "System: be kind", "what is it?", "", "A: no"])
    rows = [(c, t, None, "\n".join(line() for _ in range(rng.choice([1, 1, 2])))) for c in range(25) for t in range(3)]
    rows += [(c, 1, None, "repeated turn") for c in range(3)]
    learned = [(100 + c, t, "user" if t % 2 == 0 else "assistant", line()) for c in range(30) for t in range(4)]
    schema = "conv_id long, turn long, role string, text string"
    model = chat.fit(spark.createDataFrame(learned, schema))
    frame = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(chat, "SEGMENT", 2)
    got = {}
    for r in chat.format_chats(frame, model).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role_pred))
    turns = {}
    for r in chat._turns(frame).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text, r.syms))
    for c, ts in turns.items():
        ts.sort(key=lambda x: x[:2])
        syms = [(s, n) for n, (_, _, ss) in enumerate(ts) for s in ss]
        if len(syms) > 5:
            continue
        best, path = -np.inf, None
        for p in itertools.product(range(chat.STATES), repeat=len(syms)):
            score = model["start"][p[0]] + sum(model["move"][a, b] for a, b in zip(p, p[1:])) + sum(model["emit"][s, x] for (s, _), x in zip(syms, p, strict=True))  # noqa: B905
            if score > best:
                best, path = score, p
        want = [(ts[n][0], chat.ROLES[x // 2]) for (_, n), x in zip(syms, path, strict=True) if x % 2 == 0]
        assert sorted(got[c]) == sorted(want)
    assert sum(len([s for _, _, ss in ts for s in ss]) <= 5 for ts in turns.values()) > 10


def test_licenses_odd_tables(spark):
    rows = [(i, f"some words about number {i}\nand more of them") for i in range(40)] + [(50, None), (51, ""), (52, "  \n "), (None, "Released under the MIT License."), (53, "plain words " * 100_000)]
    rows += [(54, "Licensed under CC BY 4.0."), (54, "Licensed under CC BY 4.0.")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r.licenses for r in got if r.licenses) == ["cc-by", "cc-by", "mit"]
    assert licenses.scan(docs(spark, rows).filter("false")).count() == 0


def test_pipeline_is_a_plain_run(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    duckdb = pytest.importorskip("duckdb")
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [[i, say(rng.randrange(20, 90)), "en", rng.choice(["a", "b", "b", "c", None])] for i in range(160)]
    for i in range(0, 160, 4):
        rows[i][1] += " you vile wretch"
    rows += [[200 + i, rows[i][1], "en", "a"] for i in range(1, 12, 2)]  # exact copies
    rows += [[300 + i, rows[i][1] + " end", "en", "b"] for i in range(1, 40, 5)]  # near copies
    rows += [[400, None, "en", "a"], [401, "", "en", None], [402, "two words", "en", "a"], [402, "two words", "en", "a"]]
    docs(spark, [tuple(r) for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()))
    kept = [(d, t, s) for d, t, _, s in rows if "vile wretch" not in (t or "")]
    latest = {}
    for d, t, s in kept:
        if (t or "") not in latest or latest[t or ""][0] < d:
            latest[t or ""] = (d, t, s)
    kept = sorted(latest.values(), key=lambda r: r[0])
    least = brute_components([(d, t) for d, t, _ in kept], 80)[0]
    kept = [r for r, c in zip(kept, least, strict=True) if r[0] == c]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", kept)
    times = {r[0]: r[1] for r in con.execute(f"select doc_id, repeats from ({mixing.SQL})").fetchall()}
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text, _ in kept:
        ids = t.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want += [(d, len(ids), digest(",".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False)))] * times[d]
    assert got == sorted(want) and len(got) > 50


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{i}" for i in range(40_000))
    for rows in ([], [(None, None), (None, ""), (1, "a"), (1, "a"), (2, long), (3, long + " x")]):
        frame = docs(spark, rows)
        kept = {"toxicity": [1, 1, 2, 3, None, None], "exact_dedup": [1, 2, 3, None], "near_dedup": [1, 1, 2, None, None], "bpe": [1, 1, 2, 3, None, None]}
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert name == "bpe" or out.columns == frame.columns
            ids = sorted((r.doc_id for r in out.collect()), key=lambda i: (i is None, i))
            if name == "mixing":  # all rows are of one source, so each is taken about once; none is new
                assert set(ids) <= {1, 2, 3, None} and bool(ids) == bool(rows)
            else:
                assert ids == (kept[name] if rows else [])
