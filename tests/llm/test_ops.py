"""Corpus operators against brute force, round trips and odd inputs."""

import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoloom.llm import bpe_lexicon, embedding_dups, hnsw, mixing, near_dups, quality_pu, quality_rules, registry, secrets, token_files, toxicity, url_filter
from isoloom.llm.text_stats import with_stats

WORD = re.compile("[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in texts], DOC)


ODD = [None, "", " \n ", "one", "a b c d", "x " * 30, "tab\tvt\x0bff\x0c end", "word " * 3000]


# ---- statistics and rules ---------------------------------------------------------------------------------


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    r = np.random.default_rng(1)
    texts = ODD + [" ".join(r.choice(list("abcd#\n"), 60)) for _ in range(20)] + ["a\nb\na\n \nb", "é ü x #$"]
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in with_stats(docs_of(spark, rows)).collect()}
    assert got == {i: brute_stats(t) for i, t in rows}


def test_decision_list_finds_the_planted_rule(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(600):
        bad = k % 6 == 0
        rows.append({"n_words": 100, "word_chars": 500, "n_symbols": int(r.integers(100, 200) if bad else r.integers(0, 20)), "n_dup_lines": 0, "n_lines": 5, "n_repeat_words": 0, "n_upper": 5, "n_marks": 0, "n_digits": int(r.integers(0, 50)), "label": 0 if bad else 1})
    rules = quality_rules.learn(rows)
    assert rules.rules and rules.rules[0][0].name == "symbol_share"
    got = quality_rules.judge(docs_of(spark, [(1, "clean words go here " * 8 + "."), (2, "#$% #### word$$$ " * 12), (3, None)]), rules).collect()
    assert {x.doc_id: x.kept for x in got}[3] is False
    assert quality_rules.learn([]).rules == []
    assert quality_rules.judge(docs_of(spark, []), quality_rules.learn([])).count() == 0


# ---- toxicity and quality ---------------------------------------------------------------------------------


def toxic_rows(n=900, seed=3):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "he"], 3)) for _ in range(400)]
    bad = ["vilest", "grubby", "loathsome", "wretch", "scumbag"]
    text = lambda y: " ".join(r.permutation([*r.choice(vocabulary, 60), *(r.choice(bad, 4) if y else [])]))
    return [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(n)], text, vocabulary


def test_toxicity_separates_planted_words(spark):
    train, text, _ = toxic_rows()
    m = toxicity.learn(train)
    s = m.scores([text(True) for _ in range(20)] + [text(False) for _ in range(20)] + [None, ""])
    assert (s[:20] >= 0.5).mean() > 0.9 and (s[20:] < 0.5).mean() > 0.9
    assert toxicity.learn([]).scores(["x"]).tolist() == pytest.approx([0], abs=1e-4)
    got = toxicity.score(docs_of(spark, list(enumerate(ODD))), m).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 for x in got)


def test_both_dictionaries_are_trained_ones():
    train, _, vocabulary = toxic_rows()
    m = toxicity.learn(train)
    for d in (m.toxic, m.ordinary):
        assert d[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary's magic number, its entropy tables behind it
    assert b"grubby" in m.toxic and b"grubby" not in m.ordinary and vocabulary[0].encode() in m.ordinary
    bad, plain = m.cells(["grubby"]), m.cells(vocabulary[:50])
    assert bad[0][0] > np.mean([x for x, _ in plain]) + 2  # shorter by bytes with the toxic dictionary


def test_toxic_words_late_in_long_runs_are_evidence():
    train, _, vocabulary = toxic_rows()
    m = toxicity.learn(train)
    for by in (",", "-", "/", "~~"):
        late, clean = by.join([*vocabulary[:30], "scumbag", "thereon", "grubby", *vocabulary[30:60]]), by.join(vocabulary[:60])
        best = m.evidence(["scumbag grubby", late, clean, " ".join(vocabulary[:60])])
        assert best[1][0] == best[0][0] > 0 and best[2] == best[3], by
    for n in (64, 65, 127, 128, 129, 200, 1000):  # every stretch of half a window lies in a window
        run = "".join(chr(0x4E00 + k) for k in range(n))
        assert all(any(run[k : k + 12] in w for w in toxicity.windows(run)) for k in range(n - 11))


def test_toxicity_fit_over_tables_equals_the_one_in_memory(spark):
    train, _, _ = toxic_rows(600)
    docs = docs_of(spark, [(k, t) for k, (t, _) in enumerate(train)])
    labels = spark.createDataFrame([(k, y, y) for k, (_, y) in enumerate(train)], "doc_id long, quality int, toxic int")
    learnt = [(t, y) for k, (t, y) in enumerate(train) if zlib.crc32(str(k).encode()) % 5]
    a, b = toxicity.fit(docs.repartition(5), labels), toxicity.learn(learnt)
    assert a.toxic == b.toxic and a.worth == b.worth and a.curve == pytest.approx(b.curve, rel=1e-6)
    assert toxicity.fit(docs.limit(0), labels).scores([""]).tolist() == pytest.approx([0], abs=1e-4)


def test_positive_unlabelled_learning_recovers_prior_and_order():
    r = np.random.default_rng(4)
    good = lambda n: r.normal(0, 1, (n, 3))
    bad = lambda n: r.normal(0, 1, (n, 3)) + [4, 0, 0]
    m = quality_pu.learn(good(1500), np.vstack([good(1600), bad(400)]), ["a", "b", "c"])
    assert 0.65 < m.prior < 0.95
    score = lambda x: 1 / (1 + np.exp(-(np.clip((x - m.mean) / m.scale, -8, 8) @ m.weights + m.bias)))
    assert (score(good(300)) >= 0.3).mean() > 0.95 and (score(bad(300)) < 0.3).mean() > 0.8


def test_quality_keeps_clashing_columns_and_empty_tables(spark):
    m = quality_pu.learn(np.empty((0, 16)), np.empty((0, 16)), list(quality_pu.features()))
    df = docs_of(spark, list(enumerate(ODD))).withColumns({"n_words": F.lit(7), "row": F.lit("r"), "score": F.lit("s")})
    got = quality_pu.keep_good(df, m)
    assert got.columns == df.columns and got.count() == len(ODD)
    assert quality_pu.score(docs_of(spark, []), m).count() == 0


# ---- urls ------------------------------------------------------------------------------------------------


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        rule, verdict = max(fit, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in url_filter.DOMAINS) else "allow"


def test_url_cascade_is_exact(spark):
    hosts = ["a.org", "example.org", "X.Example.ORG", "b.com", "com", "spam-farm.example.net", "www.free-bets.example.com", "org", "notorg", "c.net", "", "a..com"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?x", "/fr/", "/de/7#t", "?q=/fr/", "#/de/"]
    urls = [None, "", "no scheme", "http://", "://org/"] + [f"https://{h}{p}" for h in hosts for p in paths]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0)).count() == 0


# ---- token files and lexicon -------------------------------------------------------------------------------


def test_frames_give_back_documents_and_notice_damage():
    r = np.random.default_rng(5)
    want = {k * 3: r.integers(0, 50_000, r.integers(0, 700)).astype("<u4") for k in range(40)}
    sink = io.BytesIO()
    w = token_files.Writer(sink)
    for k, v in want.items():
        w.add(k, v.tobytes())
    w.close()
    raw = sink.getvalue()
    reader = token_files.Reader(pa.BufferReader(raw))
    assert len(reader.frames) >= sum(len(v) > 0 for v in want.values()) and all((want[k] == v).all() and len(want[k]) == len(v) for k, v in reader.documents())
    read = []
    reader.frame = lambda k, packed=None, f=reader.frame: read.append(k) or f(k, packed)
    assert [k for k, _ in reader.documents([30, 33, 90])] == [30, 33, 90] and len(read) == 3  # a frame for each, no other
    assert list(reader.documents([1])) == []
    big = io.BytesIO()
    w = token_files.Writer(big, frame_ids=500)
    for k, v in want.items():
        w.add(k, v.tobytes())
    w.close()
    assert all((want[k] == v).all() for k, v in token_files.Reader(pa.BufferReader(big.getvalue())).documents())
    broken = bytearray(raw)
    broken[int(reader.frames[0, 0]) - 3] ^= 1
    with pytest.raises(Exception):
        list(token_files.Reader(pa.BufferReader(bytes(broken))).documents())


@pytest.mark.parametrize("batch", [40, 4_000_000])
def test_encoder_matches_the_library_on_odd_texts(monkeypatch, batch):
    """Marks, line feeds, blanks and special strings in any order, in one batch and cut into segments."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BATCH", batch)
    path = public_tokenizers.path(token_files.VOCABULARY)
    r = np.random.default_rng(5)
    parts = ["a", "É", "ß", "\u024f", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "'", "'s", "1", "23", "\u3000", "\xa0", "\x85", "中", "$", "<|endoftext|>", "\0", "-", "]", "\\", "the", "\r\n", "\u01c5", "×", "\x1c", '"', "e\u0301"]
    texts = ["".join(r.choice(parts, r.integers(0, 60))) for _ in range(3000)] + ["", " "]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_files.Encoder(path).encode(texts) == want
    assert token_files.Encoder(path).encode([]) == []


def test_token_files_match_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = ODD + ["a  b   c\n d", "It's 'S \n\n x", "<|endoftext|> x", "日本 x²", "a.\nb,\n\nc"]
    files = token_files.write(docs_of(spark, list(enumerate(texts))[::-1]), f"file://{tmp_path}/t", path)
    start = 0
    got = {r.doc_id: r for r in token_files.read(spark, f"file://{tmp_path}/t", files).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write(docs_of(spark, []), f"file://{tmp_path}/u", path) == []


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = np.random.default_rng(6)
    words = {"".join(r.choice(list("abc"), r.integers(1, 8))).encode(): [k, k + 1][: 1 + k % 2] for k in range(500)}
    (tmp_path / "x").write_bytes(bpe_lexicon.compile_lexicon(words))
    lex = bpe_lexicon.Lexicon(str(tmp_path / "x"))
    assert all(np.frombuffer(lex.ids(w), "<u4").tolist() == v for w, v in words.items())
    assert lex.ids(b"zzz") is None and lex.ids(b"") is None and lex.ids(b"abcabcabcabc") is None
    assert lex.states < sum(map(len, words))
    suffixes = {(p + "ation").encode(): [1] for p in ("n", "st", "rel")}
    (tmp_path / "y").write_bytes(bpe_lexicon.compile_lexicon(suffixes))
    assert bpe_lexicon.Lexicon(str(tmp_path / "y")).states <= 1 + 3 + 6


def test_codec_matches_the_library(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe_lexicon.VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = ODD + ["It's WE'LL 'twas", "ÀÉ cómo ΣΑΣ İ", "<|endoftext|>x", "a\x1cb", "½ 12 x²!!", "日本 😀", "a" * 200]
    df = docs_of(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in bpe_lexicon.encode(df, path, bpe_lexicon.build_lexicon(df, path, 20)).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- mixing ----------------------------------------------------------------------------------------------


def test_budget_is_met_exactly_where_it_can_be():
    r = np.random.default_rng(7)
    for _ in range(20):
        size = np.unique(r.integers(0, 300, 40))
        have = r.integers(1, 9, len(size))
        budget = int(r.integers(0, (size * have).sum() + 1))
        take = mixing.fit_budget(size, have, budget)
        assert (take >= 0).all() and (take <= have).all()
        assert budget - 2 <= (size * take).sum() <= budget
    for low, high, cells in ((40_000, 60_000, 1 << 18), (1, 300, 1 << 12), (500, 20_000, 1 << 18)):  # beyond one round
        size = np.unique(r.integers(low, high, 200))
        have = r.integers(1, 400, len(size))
        budget = int((size * have).sum() * 0.37)
        take = mixing.fit_budget(size, have, budget, cells)
        assert (take <= have).all() and 0 <= budget - (size * take).sum() <= 0.001 * low + 20
    small = mixing.fit_budget(np.array([3, 5]), np.array([2, 1]), 7)
    assert (small * [3, 5]).sum() == 6
    assert mixing.fit_budget(np.array([0]), np.array([4]), 0).tolist() == [0]


def test_targets_reshare_the_excess():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(240) and all(got[k] <= 2 * n for k, n in (("b", 100), (None, 50)))


def test_mix_over_sources_nulls_and_repeats(spark):
    r = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(r.integers(0, 40))) or None, "en", [None, "x", "y"][k % 3], 0) for k in range(300)]
    df = spark.createDataFrame(rows + rows[:3], DOC)
    got = mixing.draw(df).collect()
    assert len(got) == 303 and all(x.times in (0, 1, 2) for x in got)
    for s in (None, "x", "y"):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.size * x.times for x in mine) - mine[0].target) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.draw(df.repartition(7)).collect()), key=str)
    assert mixing.draw(docs_of(spark, [])).count() == 0
    odd = ("__n", "__id", "__times", "times", "row", "id", "of", "col", "size")
    wide = df.withColumns({c: F.concat(F.lit(c), df.doc_id) for c in odd})
    kept = mixing.mix(wide)
    assert kept.columns == wide.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in kept.collect() for c in odd)


# ---- secrets ---------------------------------------------------------------------------------------------


def test_base_patterns():
    t = 'Token = "abcdef" password:abc api_key="x.y-z/1" AKIA' + "A" * 16 + " AKIAA " + "a1" * 12 + " " + "a1" * 11
    kinds = [(k, t[s:e]) for k, s, e in secrets.Scanner().spans(t)[0]]
    assert kinds == [("assign", 'Token = "abcdef'), ("assign", 'api_key="x.y-z/1'), ("access", "AKIA" + "A" * 16), ("hex", "a1" * 12)]
    assert secrets.Scanner().spans(None) == ([], [])


def test_automata_know_formats_they_did_not_see():
    grammars = secrets.automata()
    for kind, many in secrets.published(seed=99, each=60).items():
        got = [secrets.best_format(x, grammars) for x in many if len(x) >= 16]
        share = sum(x == (None if kind == "ordinary" else kind) for x in got) / len(got)
        assert share > 0.9, kind


def test_credentials_behind_other_run_characters_are_found():
    keys = {k: v[0] for k, v in secrets.published(seed=5, each=1).items() if k != "ordinary"}
    scanner = secrets.Scanner()
    for kind, key in keys.items():
        for before, after in (("https://", "@github.com"), ("/", ""), ("key/", " x"), ("v1.", ""), ("x_", "/more"), ("abc", ""), ("a=", "+b")):
            at = len(before)
            assert scanner.grammar_spans(before + key + after) == [(at, kind, at + len(key))], (kind, before)
    several = "/".join(keys.values())
    found = scanner.grammar_spans(several)
    assert [(k, several[s:e]) for s, k, e in found] == list(keys.items())
    assert scanner.grammar_spans("https://example.org/some/long-path_of.words") == []


def test_redaction_keeps_other_texts(spark):
    key = secrets.published(seed=5, each=1)["github"][0]
    df = docs_of(spark, [(1, f"my key {key}."), (2, "nothing here"), (3, None), (4, "")])
    got = {r.doc_id: r for r in secrets.redact(df, secrets.automata()).collect()}
    assert got[1].text == "my key <SECRET>." and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4)] == ["nothing here", None, ""]


# ---- near copies ------------------------------------------------------------------------------------------


def brute_groups(sets, linked):
    ids = sorted(sets)
    links = {i: [j for j in ids if j != i and linked(sets[i], sets[j])] for i in ids}
    root = {}
    for i in ids:
        todo, low = [i], i
        seen = {i}
        while todo:
            k = todo.pop()
            low = min(low, k)
            todo += [j for j in links[k] if j not in seen and not seen.add(j)]
        root[i] = low
    return {i: (len(links[i]), root[i]) for i in ids}


def test_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "EXACT_BLOCK", 8)
    r = np.random.default_rng(9)
    base = [[f"w{x}" for x in r.integers(0, 3000, 120)] for _ in range(6)]
    rows = []
    for k in range(150):
        w = list(base[0] if k % 3 == 0 else base[k % 6])
        for _ in range(int(r.integers(0, 5))):
            w[int(r.integers(0, len(w)))] = f"n{r.integers(0, 9999)}"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a  b"), (204, "b a")]
    got = {x.doc_id: (x.n_links, x.component_id) for x in near_dups.groups(docs_of(spark, rows)).collect()}
    sets = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    assert got == brute_groups(sets, lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b))


def test_keep_one_keeps_clashing_columns(spark):
    t = " ".join(f"w{k}" for k in range(30))
    odd = ("__k", "__n", "n", "kept", "rank", "component_id", "k1", "sig")
    df = docs_of(spark, [(1, t), (1, t), (2, t), (3, "alone")])
    df = df.withColumns({c: F.concat(F.lit(c), df.doc_id) for c in odd})
    got = near_dups.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in odd)


def test_components_of_a_star_and_a_chain(spark):
    from isoloom.llm.graph import components

    edges = [(0, k) for k in range(1, 2000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(7, 7), (3000, 3001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: 0 for k in range(2000)} | {5000 + k: 5000 for k in range(41)} | {3000: 3000, 3001: 3000}


def test_keep_one_handles_repeated_rows(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = docs_of(spark, [(1, t), (1, t), (2, t), (3, "other words that stand alone here"), (None, t), (4, None)])
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near_dups.keep_one(df).collect())
    assert got == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert near_dups.keep_one(docs_of(spark, [])).count() == 0


def test_bayes_table_is_lenient_at_the_threshold():
    r = np.random.default_rng(10)
    hits = r.random((20_000, near_dups.HASHES)) < 0.8
    ok = np.ones(len(hits), bool)
    for n, least in zip(near_dups._STEPS, near_dups._LEAST):
        ok &= hits[:, :n].sum(1) >= least
    assert ok.mean() > 0.999


# ---- embeddings ------------------------------------------------------------------------------------------


def test_embedding_groups_against_brute_force(spark):
    r = np.random.default_rng(11)
    centre = r.normal(0, 1, (40, 24))
    v = [(centre[k % 40] + r.normal(0, 0.12, 24)).astype(np.float32) for k in range(900)]
    rows = [(k, x.tolist(), int(k % 40 % 3) if k % 50 else None) for k, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None] * 24, 1), (1004, rows[1][1], rows[1][2]), (1005, rows[1][1][:12], rows[1][2]), (None, rows[1][1], 1)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dups.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("shard", F.lit(1)), shard=400).collect()}
    fine = {k: (np.array(x, np.float64), y) for k, x, y in rows if k is not None and x and y is not None and None not in x and np.isfinite(np.array(x, float)).all() and any(x)}
    cos = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= 0.93
    want = {k: (0, k) for k, _, _ in rows if k is not None} | brute_groups(fine, cos)
    total = sum(n for n, _ in want.values())
    assert total > 1000 and sum(got[k][0] for k in want) >= 0.99 * total
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)
    assert embedding_dups.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    r = np.random.default_rng(12)
    x = r.normal(0, 1, (2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    ids, _ = g.search(x[:100].astype(np.float32), 32)
    top = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    found = np.mean([len(set(g.order[i[i >= 0]]) & set(t)) / 10 for i, t in zip(ids, top)])
    assert found > 0.9
    again = hnsw.Graph.loads(g.dumps())
    assert (again.search(x[:5].astype(np.float32), 8)[0] == g.search(x[:5].astype(np.float32), 8)[0]).all()


def test_components_of_doubles_beyond_floats(spark):
    near = [1.0, 0.3953, 0.0]
    far = [1e39, 0.0, 0.0]
    cos = near[0] / np.linalg.norm(near)
    rows = [(1, far, 1), (2, near, 1), (3, [x * 1e39 for x in near], 1), (4, [1e39, float("inf"), 0.0], 1)]
    got = {x.vec_id: x.n_links for x in embedding_dups.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 2 * (cos >= 0.93), 2: 1 + (cos >= 0.93), 3: 1 + (cos >= 0.93), 4: 0}


# ---- the queries over whole tables and odd ones ---------------------------------------------------------------

CLASH = ("__n", "__id", "__k", "row", "w", "t", "score", "n_words", "ids", "rank", "kept", "spans", "held_out", "size")


def odd_tables(spark, folder):
    """Tables with nulls in every column, empty and very long texts, repeated rows and clashing column names."""
    r = np.random.default_rng(21)
    words = ["".join(r.choice(["th", "er", "on", "an", "ñu", "ße"], 3)) for _ in range(300)]
    key = secrets.published(seed=8, each=1)["github"][0]
    texts = [*ODD, "x" * 300_000, " ".join(r.choice(words, 60_000)), f'token = "{"0a" * 20}" and {key}', "日本語" * 400, "#$%&" * 50, "a\n" * 100]
    texts += [" ".join(r.choice(words, int(n))) for n in r.integers(1, 300, 120)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None if t is None or i % 7 == 0 else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[20], rows[20], (None, texts[30], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    df.withColumns({c: F.lit(c) for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0) if i % 6 else None, int(i % 9 == 0) if i % 5 else None) for i in range(len(texts))] + [(None, 1, 1), (30, 0, 1), (31, 1, 0), (31, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit("x")).write.parquet(f"{folder}/labels.parquet")
    df.limit(0).withColumns({c: F.lit(c) for c in CLASH}).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    return folder, odd_tables(spark, folder)


def shown(rows):
    return Counter(tuple("" if v is None else repr(v) for v in r) for r in rows)


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op8_quality_classifier"])
def test_scores_of_odd_tables(spark, odd, name):
    folder, rows = odd
    query = registry.queries()[name]
    got = query(spark, folder).collect()
    cut = 0.5 if name.startswith("op1") else 0.3
    assert shown((r.doc_id, r.held_out) for r in got) == shown((r[0], held(r[0])) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    same = {}
    for r in got:  # repeated rows and equal texts score alike
        if r.doc_id is not None:
            assert same.setdefault(r.doc_id, r.score) == r.score
    assert query(spark, f"{folder}/none").count() == 0


def test_rules_of_odd_tables_against_brute_force(spark, odd):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality_rules.DecisionList([[quality_rules.Condition("symbol_share", True, 0.2), quality_rules.Condition("word_length", False, 4.0)], [quality_rules.Condition("repeat_share", True, 0.1)], [quality_rules.Condition("word_length", True, 12.0)]])

    def want(k, t):
        n, chars, symbols, lines, repeats = brute_stats(t)
        failed = n < 20 or 100 * repeats > 30 * n
        fits = [symbols / max(chars, 1) >= 0.2 and chars / max(n, 1) <= 4.0, repeats / max(n, 1) >= 0.1, chars / max(n, 1) >= 12.0]
        rule = fits.index(True) + 1 if any(fits) else 0  # the first that fits, in order
        return k, n, chars, symbols, lines, repeats, failed, rule, not failed and not rule

    got = quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept").collect()
    assert shown(got) == shown(want(r[0], r[1]) for r in rows)
    q = registry.queries()["op3_quality_rules"]
    fitted = q(spark, folder).collect()
    assert shown((r.doc_id, r.n_words, r.base_failed) for r in fitted) == shown((w[0], w[1], w[6]) for w in (want(r[0], r[1]) for r in rows))
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in fitted) and q(spark, f"{folder}/none").count() == 0


def test_token_files_of_odd_tables_against_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows = odd
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    want = []
    for k, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, len(ids), zlib.crc32(ids.tobytes())))
    q = registry.queries()["op4_token_files"]
    got = q(spark, folder).collect()
    assert shown((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == shown(want)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0)) and q(spark, f"{folder}/none").count() == 0


def test_lexicon_on_odd_tables_against_the_library(spark, odd):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows = odd
    t = Tokenizer.from_file(public_tokenizers.path(bpe_lexicon.VOCABULARY))
    want = []
    for k, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    q = registry.queries()["op5_bpe_lexicon"]
    assert shown(q(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == shown(want)
    assert q(spark, f"{folder}/none").count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = public_tokenizers.path(bpe_lexicon.VOCABULARY)
    wide = bpe_lexicon.encode_columns(docs, path, bpe_lexicon.build_lexicon(docs, path))
    assert wide.columns == [*docs.columns, "ids_", "decoded"] and wide.where("ids <> 'ids'").count() == 0


def test_frequent_words_come_from_the_lexicon_and_others_alone_are_merged(tmp_path):
    import public_tokenizers

    v = bpe_lexicon.vocabulary(public_tokenizers.path(bpe_lexicon.VOCABULARY))
    (tmp_path / "x").write_bytes(bpe_lexicon.compile_lexicon({w.encode(): v.merge(w) for w in ("common", "words", ",")}))
    codec = bpe_lexicon.Codec(v, bpe_lexicon.Lexicon(str(tmp_path / "x")))
    whole = []
    v_merged = v.merged
    v.merged = lambda texts: whole.extend(texts) or v_merged(texts)
    try:
        got = codec.encode("common words, (common zzyzx)words zzyzx")
    finally:
        v.merged = v_merged
    assert got == v.merged(["common words, (common zzyzx)words zzyzx"])[0] and not whole
    assert codec.taken["lexicon"] >= 4 and codec.taken["merged"] >= 2 and codec.taken["merged"] <= 4


def test_mixing_of_odd_tables_against_brute_force(spark, odd):
    folder, rows = odd
    size = lambda t: len(WORD.findall(t or ""))
    own = {}
    for r in rows:
        own[r[3]] = own.get(r[3], 0) + size(r[1])
    goal, order = {}, sorted(own, key=lambda s: (s is None, s or ""))
    rest, free = 1.5 * sum(own.values()), {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    while free:
        over = [s for s in free if rest * free[s] / sum(free.values()) > 2 * own[s]]
        if not over:
            goal |= {s: rest * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            goal[s] = 2.0 * own[s]
        for s in over:
            rest -= goal[s]
            del free[s]
    q = registry.queries()["op6_mixing"]
    got = q(spark, folder).collect()
    assert shown((r.doc_id, r.size) for r in got) == shown((r[0], size(r[1])) for r in rows)
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    by = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = Counter()
    for r in got:
        s = by.get(r.doc_id)
        assert r.source_size == own[s] and r.target == pytest.approx(goal[s])
        taken[s] += r.taken
    for s in own:  # as near from below as any choice of documents comes
        epochs = min(2, int(goal[s] // own[s]))
        budget, reach = round(goal[s] - epochs * own[s]) if epochs < 2 else 0, 1
        for r in rows:
            if r[3] == s:
                reach |= reach << size(r[1])
        assert taken[s] == epochs * own[s] + (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    assert shown(got) == shown(q(spark, folder).collect()) and q(spark, f"{folder}/none").count() == 0


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_secrets_against_brute_force(spark, odd, where):
    import hashlib

    folder = odd[0] if where == "odd" else where
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for k, t in rows:
        base = brute_secrets(t or "")
        n = [sum(b[1] == k for b in base) for k in range(3)]
        text = ",".join(f"{secrets.BASE_KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((k, *n, hashlib.sha256(text.encode()).hexdigest()))
    got = registry.queries()["op7_secret_scans"](spark, folder).collect()
    assert shown(r[:5] for r in got) == shown(want)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        if r.doc_id is not None:
            spans = [x.split(":") for x in r.spans.split(",") if x]
            base = {f"{secrets.BASE_KINDS[k]}:{s}:{e}" for s, k, e in brute_secrets(text[r.doc_id] or "")}
            assert base <= set(r.spans.split(",")) and all(0 <= int(s) < int(e) <= len(text[r.doc_id]) for _, s, e in spans)
    if where == "odd":
        assert any("github:" in r.spans for r in got) and registry.queries()["op7_secret_scans"](spark, f"{folder}/none").count() == 0


def test_automata_of_the_corpus_find_credentials_without_their_keyword(spark):
    r = np.random.default_rng(31)
    pick = lambda letters, n: "".join(r.choice(list(letters), n))
    words = [pick("etaoinshr", int(n)) for n in r.integers(2, 12, 400)]
    prose = lambda: " ".join(r.choice(words, 40))
    secret = lambda: pick("0123456789abcdef", 18)
    texts = [f"{prose()} password={secret()} {prose()}" if k % 2 else f"{prose()} {r.integers(10**6, 10**9)} mail{k}.example.com" for k in range(200)]
    planted = [secret() for _ in range(60)]
    late = [f"{prose()} {s} {prose()}" for s in planted]
    docs = docs_of(spark, list(enumerate(texts + late)))
    grammars = secrets.fit(docs)
    assert "like_assign" in grammars
    rows = {x.doc_id: x for x in secrets.scan(docs, grammars).collect()}
    found = [any(k.startswith("like_assign") and t[int(a) : int(b)] == s for k, a, b in (x.split(":") for x in rows[len(texts) + i].spans.split(",") if x)) for i, (s, t) in enumerate(zip(planted, late))]
    assert np.mean(found) > 0.9 and all(rows[len(texts) + i].n_assign == 0 for i in range(len(late)))
    assert all(rows[k].spans == "" for k in range(0, 200, 2))  # clean documents are left alone
    hidden = secrets.redact(docs, grammars).where(F.col("doc_id") >= len(texts)).collect()
    assert np.mean([s not in x.text for s, x in zip(planted, sorted(hidden, key=lambda x: x.doc_id))]) > 0.9


def test_quality_trusts_no_id_that_is_labelled_both_ways(spark):
    from isoloom.llm.common import label_of

    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    ids = lambda only: {r.doc_id for r in label_of(labels, "quality", 10, only).collect()}
    free = {k for k in (1, 2, 3) if not held(k)}
    assert ids(None) == free and ids(1) == free & {1}


def test_near_copies_of_odd_tables(spark, odd):
    folder, rows = odd
    q = registry.queries()["op10_ngram_jaccard_join"]
    got = q(spark, folder).collect()
    text = {}
    for r in rows:
        if r[0] is not None:
            text[r[0]] = r[1]
    sets = {}
    for k, t in text.items():
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    want = brute_groups(sets, lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b))
    assert {r.doc_id: (r.n_links, r.component_id) for r in got if r.doc_id is not None} == want
    assert sum(r.doc_id is None for r in got) == 2 and q(spark, f"{folder}/none").count() == 0


def test_urls_keep_their_rows_whatever_the_other_columns(spark):
    urls = ["http://a.org/x", None, "http://a.org/x", "http://A.com/fr/" + "y" * 100_000]
    df = spark.createDataFrame([(i, u, None, "h", "p", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
