"""Operators on texts against plain versions, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm import bpe, fingerprints, neardup, packing, pii, quality, secrets, substrings, toxicity

from .conftest import LONG, PASSAGE, ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_repeats_against_all_windows(docs):
    n = 35
    words = [WORD.findall(t or "") for _, t in ROWS]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    want = []
    for (key, _), w in zip(ROWS, words):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = found(substrings.remove_repeats(docs, n, whole=False), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=repr)


def test_repeats_keep_columns_and_untouched_texts(docs, none):
    got = substrings.remove_repeats(docs, 50, keep=["doc_id", "text", "lang"])
    rows = {r.doc_id: r for r in got.where("doc_id in (1, 9)").collect()}
    assert rows[1].kept_text == "Start here. end one." and rows[1].n_removed == 60
    assert rows[9].kept_text == rows[9].text and rows[9].lang == "en"
    assert substrings.remove_repeats(none, 50).count() == 0


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "part"), [(3, 85), (5, 80)])
def test_near_copies_against_all_pairs(spark, n, part):
    rng = np.random.default_rng(3)
    texts, base = [], [f"w{k}" for k in rng.integers(0, 400, 120)]
    for k in range(120):
        own = list(base) if k % 3 else [f"v{x}" for x in rng.integers(0, 50, rng.integers(1, 60))]
        for _ in range(int(rng.integers(0, 12))):
            own[int(rng.integers(0, len(own)))] = f"x{int(rng.integers(0, 9))}"
        texts.append((k + 10, " ".join(own)))
    texts += [(5, None), (6, ""), (7, "Just Two"), (8, "just two")]
    sets = {k: shingles(t, n) for k, t in texts}
    root = {k: k for k in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = found(neardup.near_duplicates(df, n, (part, 100), block=16), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(k, len(sets[k]), root[k], root[k] == k) for k in sets], key=repr)


def test_near_copies_of_odd_rows(docs, none):
    rows = found(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert len(rows) == len(ROWS)
    by = dict((r[0], r) for r in rows)
    assert by[3][2:] == (3, True) and by[4][2:] == (3, False) and by[None][2:] == (None, True)
    assert by[5][1:] == (0, 5, True) and by[6][1:] == (0, 6, True) and by[12][1] == 1
    assert neardup.near_duplicates(none).count() == 0


def test_bands_miss_little():
    for t in (0.5, 0.8, 0.85, 0.95, 1.0):
        rows, bands = neardup.bands_for(t)
        assert (1 - t**rows) ** bands <= neardup.MISS * 1.001


def test_bpe_as_the_library(docs, none, byte_path):
    whole = Tokenizer.from_file(byte_path)
    want = []
    for key, text in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(back)))
    assert found(bpe.bpe_round_trip(docs, byte_path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.bpe_round_trip(none, byte_path).count() == 0
    coded = bpe.bpe_encode(docs, byte_path)
    back = bpe.bpe_decode(coded, byte_path)
    assert found(back, "doc_id", "text") == sorted([(k, t or "") for k, t in ROWS], key=repr)


def test_long_pieces_as_the_library(byte_path):
    whole, vocab = Tokenizer.from_file(byte_path), bpe.vocabulary(byte_path)
    for text in ("ab" * 900, "a" * 3000, "é" * 600, " " * 1500 + "x"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert vocab.encode(text) == ids and vocab.decode(ids) == text
        piece = text.encode()
        assert vocab.merge_one(piece[:400]) == vocab.merge_many([piece[:400]])[0]


def test_packing_of_whole_documents(docs, none, word_path):
    whole = Tokenizer.from_file(word_path)
    want = Counter()
    for key, text in ROWS:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[key, k, at, len(part), packing.zlib.crc32(part.tobytes())] += 1
    rows = packing.pack_pieces(packing.token_pieces(docs, word_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_pieces(packing.token_pieces(none, word_path)).count() == 0
    ids = packing.token_pieces(docs, word_path, with_ids=True).where("doc_id = 12").first().ids
    assert ids == [*whole.encode("one two", add_special_tokens=False).ids, 0]
    placed = packing.pack_pieces(packing.token_pieces(docs, word_path, with_ids=True), with_ids=True).where("doc_id = 12").first()
    assert placed.ids == ids and placed.length == len(ids)


def test_words_as_the_library(word_path, monkeypatch):
    odd = [*"'''''strevelmdRSTxa09 .,!-\n\t\r\x00\x1c\x85\xa0\u2003\u0301\u0307ÉςΣİıI²Ⅷ٣日ſ", "\U0001f600", "\U00010400", "\U0001d7d8", "\u1100\u1161"]
    odd += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "don't we'll", "\u212b", "\ud7ff\ue000\uffff"]
    rng = np.random.default_rng(5)
    texts = ["".join(odd[i] for i in rng.integers(0, len(odd), rng.integers(0, 60))) for _ in range(400)]
    tokenizer = packing.WordTokenizer(word_path)
    want = [np.array(tokenizer.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    raw = [t.encode() for t in texts]
    for kept in (packing.KEPT, 50):  # with few words kept they are forgotten all the time
        monkeypatch.setattr(packing, "KEPT", kept)
        assert [x for a in range(0, 400, 7) for x in tokenizer.encode(raw[a : a + 7])] == want


def test_known_words_cost_little(word_path):
    text = LONG * 4
    tokenizer = packing.WordTokenizer(word_path)

    def seconds(job):
        def once():
            start = time.process_time()
            job()
            return time.process_time() - start

        return min(once() for _ in range(5))

    assert 10 * seconds(lambda: tokenizer.encode([text.encode()])) < seconds(lambda: tokenizer.whole.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [101, 60, 100, 35][seed], 3000).tolist()
    groups = packing.pack_lengths(sizes, 100)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 100 for g in groups)
    halves = sum(s > 50 for s in sizes)
    assert len(groups) <= 1.02 * max(halves, -(-sum(sizes) // 100)) + 1


def test_reduction_fixes_what_dominates():
    assert len(packing.pack_lengths([60, 40, 55, 45, 70, 30], 100)) == 3
    assert len(packing.pack_lengths([51, 51, 51], 100)) == 3
    assert len(packing.pack_lengths([], 100)) == 0
    assert len(packing.pack_lengths([1000, 1000, 20, 10, 5], 2048)) == 1
    assert len(packing.pack_lengths([40, 30, 20, 5, 3, 2], 100)) == 1


def test_few_pieces_against_all_ways():
    def best(left, rooms):
        if not left:
            return len(rooms)
        size, rest = left[0], left[1:]
        ways = [best(rest, [*rooms[:i], r - size, *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= size and r not in rooms[:i]]
        return min([*ways, best(rest, [*rooms, 100 - size])])

    more = []
    for seed in range(100):
        sizes = np.random.default_rng(seed).integers(1, [40, 60, 101][seed % 3], 8).tolist()
        more.append(len(packing.pack_lengths(sizes, 100)) - best(sorted(sizes, reverse=True), []))
    assert min(more) == 0 and max(more) <= 1 and sum(more) <= 4


def test_personal_data(docs, none):
    model = pii.fit_pii(docs)
    rows = {r.doc_id: r for r in pii.find_pii(docs, model, redact=True).collect()}
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == (1, 1, 1, 1)
    assert rows[9].base == "email:5:27,ip:57:65,card:31:50,phone:72:89" and set(rows[9].base.split(",")) <= set(rows[9].spans.split(","))
    assert rows[9].redacted == "mail [EMAIL] or [CARD], host [IP], call [PHONE] now"
    assert rows[3].redacted == ROWS[2][1] and rows[6].redacted == "" and rows[8].base == ""
    assert pii.find_pii(docs, model).count() == len(ROWS) and pii.find_pii(none, pii.fit_pii(none)).count() == 0


def test_emails_as_the_pattern():
    rule = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ("a@b.c@d.e f@g", "a@b.c_d@e.f", "@x.y a@@b.c", "a.b@c..d x@y.z.", "é@a.b aé@b.c x%y@z-1.q", "a@b a@b.c@", "a@b.c.d@e.f-g.h"):
        assert pii._emails(text) == [(m.start(), m.end()) for m in rule.finditer(text)], text


def test_trees_learn_formats():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = pii.Boosted.fit(x, y, np.zeros(2000, int))
    assert np.mean((model.score(x) > 0.5) == (y > 0.5)) > 0.97 and 0.5 <= model.thresholds[0] < 1 and model.thresholds[1] == 2.0


def test_equal_scores_pass_together():
    x, y = np.zeros((800, 3)), np.repeat([1.0, 0.0], 400)
    assert pii.Boosted.fit(x, y, np.zeros(800, int)).thresholds[0] == 2.0
    x[:400, 1] = 1
    model = pii.Boosted.fit(x, y, np.zeros(800, int))
    assert ((model.score(x) >= model.thresholds[0]) == (y > 0)).all()


def test_secrets_link_complementary_parts(docs, none):
    rows = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    text = ROWS[9][1]
    assert rows[10].base == f"assign:4:{text.index(' and') - 1},access:31:51"
    kinds = [s.split(":")[0] for s in rows[10].spans.split(",")]
    assert kinds == ["assign", "access", "endpoint", "identity"]
    assert rows[6].spans == rows[5].spans == rows[3].spans == ""
    assert secrets.secret_spans(docs).count() == len(ROWS) and secrets.secret_spans(none).count() == 0


def test_weak_candidates_alone_stay_silent(spark):
    far = "x " * 200
    rows = [(1, "see https://host.example/a here"), (2, "token=abcdefgh " + far + "https://host.example/a"), (3, "https://h.example/a token=abcdefgh"), (4, "secret: token: abcdefgh")]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "", 2: "assign:0:14", 3: "endpoint:0:19,assign:20:34", 4: ""}


def test_no_part_is_its_own_complement(spark):
    alone = "see https://example.com/articles/2024-review-of-things-we-like today"
    name = "client_id: 9f8e7d6c5b4a39281706xyz"
    rows = [(1, alone), (2, alone + " with key Zx81Qw72Er63Ty54Ui45"), (3, name), (4, f"{name} at https://h.example/a"), (5, "Zx81Qw72Er63Ty54Ui45 alone")]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "", 2: "endpoint:4:62,bare:78:98", 3: "", 4: "", 5: ""}


def test_fingerprints_are_sums_of_paragraphs(spark):
    a, b = "one. two three\nfour five. six", "seven eight nine\nten"
    rows = [("a", a), ("b", b), ("ab", f"{a}\n{b}"), ("ba", f"{b}\n{a}"), ("n", None)]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "k string, text string"), ["k"])
    wide = prints.groupBy().agg(*[F.first(F.when(F.col("k") == k, F.col("fingerprint")), True).alias(k) for k, _ in rows])
    row = wide.select(
        (fingerprints.as_text(F.col("ab")) == fingerprints.as_text(F.col("ba"))).alias("order"),
        (fingerprints.as_text(fingerprints.joined(F.col("a"), F.col("b"))) == fingerprints.as_text(F.col("ab"))).alias("sum"),
        (fingerprints.as_text(fingerprints.without(F.col("ab"), F.col("b"))) == fingerprints.as_text(F.col("a"))).alias("less"),
        fingerprints.likeness(F.col("ab"), F.col("ba")).alias("same"),
        fingerprints.likeness(F.col("a"), F.col("n")).alias("empty"),
    ).first()
    assert row.order and row["sum"] and row.less and row.same == 1.0 and row.empty == 0.0


def test_likeness_follows_the_edit(docs, none):
    rows = sorted(fingerprints.neighbour_likeness(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    texts = sorted({(k, t or "") for k, t in ROWS}, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(rows) == len(ROWS)
    rows = [r for k, r in enumerate(rows) if not k or r != rows[k - 1]]
    for r, (key, text), (_, after) in zip(rows, texts, [*texts[1:], texts[0]], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = next(r for r in rows if r.doc_id == 8)
    assert long.near_edited > 0.6 and long.near_next < 0.3
    assert fingerprints.neighbour_likeness(none).count() == 0


def test_grades_order_documents(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(240):
        g = k % 3
        own = [f"good{x}" for x in rng.integers(0, 20, 40)]
        own[: [30, 8, 0][g]] = ["JUNK!!"] * [30, 8, 0][g]
        rows.append((k, " ".join(own)))
        labels.append((k, int(g > 0), int(g == 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rated = spark.createDataFrame([x for x in labels if x[0] < 180], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(docs, rated)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    held = [(k, k % 3) for k in range(180, 240)]
    assert all(got[k].selected == (g > 0) for k, g in held) and model.thresholds[0] < model.thresholds[1]
    assert np.mean([got[k].expected_grade for k, g in held if g == 1]) < np.mean([got[k].expected_grade for k, g in held if g == 2])


def test_quality_of_odd_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(docs, model, keep=["doc_id", "text", "id"]).count() == len(ROWS)
    empty = quality.fit_quality(docs, labels.where("false"))
    assert quality.score_quality(none, empty).count() == 0 and quality.score_quality(docs, empty).where("not selected").count() == 0


def test_field_finds_toxic_words(spark):
    rng = np.random.default_rng(2)
    rows, labels, marks = [], [], {}
    for k in range(300):
        own = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if k % 4 == 0:
            own[10:12] = ["Idiot", "scumxx,"][: 1 + k % 8 // 4] + ["w1"] * (1 - k % 8 // 4)
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 4 == 0)))
        marks[k] = k % 4 == 0
    docs = spark.createDataFrame(rows + [(300, None), (301, ""), (None, "Idiot")], "doc_id bigint, text string")
    field = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), allowed=F.col("doc_id") < 200)
    got = {r.doc_id: r for r in toxicity.tag_toxicity(docs, field).collect()}
    assert all((got[k].score >= 0.7) == marks[k] for k in range(200, 300)) and got[300].score == got[301].score < 0.5
    text = dict(rows)[200]
    assert got[200].spans.split(",")[0] == f"{text.index('Idiot')}:{text.index('Idiot') + 5}" and got[None].spans == "0:5"


def test_field_without_labels(docs, none, spark):
    field = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.tag_toxicity(docs, field).collect()} == {0.5}
    assert toxicity.tag_toxicity(none, field).count() == 0


def test_scan_and_marginals_against_enumeration():
    """Forward-backward marginals equal sums over all labellings, for two documents in one row of words."""
    rng = np.random.default_rng(4)
    field = toxicity.Field(np.zeros(1), np.array([-0.7, 0.3, 0.9, -1.1]), np.zeros(3))
    potential, first = rng.normal(size=7), np.array([0, 4])
    _, f, b = field.ratios(potential, first)
    got = f * b / (1 + f * b)
    ot, to, tt, begin = field.links
    for s, e in ((0, 4), (4, 7)):
        total, mass = 0.0, np.zeros(e - s)
        for code in range(1 << (e - s)):
            y = [(code >> i) & 1 for i in range(e - s)]
            weight = begin * y[0] + sum(potential[s + i] for i in range(e - s) if y[i])
            weight += sum({(0, 0): 0, (0, 1): ot, (1, 0): to, (1, 1): tt}[y[i - 1], y[i]] for i in range(1, e - s))
            total += np.exp(weight)
            mass += np.exp(weight) * np.array(y)
        assert np.allclose(mass / total, got[s:e])


def test_scan_over_many_blocks():
    rng = np.random.default_rng(6)
    a, b, c, d = rng.random((4, 1000)) + 0.01
    x, want = 1.0, []
    for t in range(1000):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        want.append(x)
    assert np.allclose(toxicity._scan(a, b, c, d), want)


def test_passage_is_the_only_loss(docs):
    got = substrings.remove_repeats(docs, 50, keep=["doc_id"]).where("doc_id = 2").first()
    assert PASSAGE not in got.kept_text and got.kept_text == "Other words lead to and more."


def test_other_forms_of_personal_data_are_added(spark):
    rng = np.random.default_rng(12)
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    texts = []
    for i in range(60):
        card = next(c for c in iter(lambda: digits(16), None) if pii.luhn(c))
        texts.append(f"words and u{i}@mail{i % 9}.example.com, then 10.{i}.3.{i} or so {card} with +1 ({digits(3)}) 555-{digits(4)} more; not {digits(16)} here")
    model = pii.fit_pii(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    forms = {"bob [at] mail [dot] com": 0, "10 . 0 . 0 . 1": 1, "4111.1111.1111.1111": 2, "(417) 555-1301": 3, "417-555-1301": 3}
    for form, kind in forms.items():
        text = f"it was {form} as said"
        assert pii.all_spans(text, model) == ([], [(kind, 7, 7 + len(form))]), form
        assert pii.redacted(text, pii.all_spans(text, model)[1]) == f"it was [{pii.KINDS[kind].upper()}] as said"
    for clean in ("order 4175551301", "on 2024-05-17 we", "8367421f83b7", "list 12, 7, 200, 4", "see you @ school. Then", "4111.1111.1111.1112", "1234567890123456"):
        assert pii.all_spans(f"it was {clean} as said", model) == ([], []), clean


def test_digits_run_together_are_no_card():
    text = next(t for d in range(10) if pii.luhn(re.sub("[^0-9]", "", t := f"+1 (826) 555-4081 190.137.223.{d}")))
    assert not pii._plausible(2, text) and pii.describe(text, 2, 0, len(text))[11] == 0.0


def test_near_copies_of_ids_with_two_texts(spark):
    rng = np.random.default_rng(12)
    text = lambda: " ".join(f"t{x}" for x in rng.integers(0, 10**6, 60))
    rows = []
    for k in range(100):
        own = text()
        rows += [(1000 + k, text()), (1000 + k, own), (2000 + k, own + " more"), (2000 + k, text())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = neardup.near_duplicates(df, 3, (85, 100))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(a + k, 1000 + k) for k in range(100) for a in (1000, 2000)}
    assert got.count() == 400 and got.where("kept").count() == 200
    apart = neardup.near_duplicates(df.unionByName(spark.createDataFrame([(1, ""), (2, None)], df.schema)), 3, (85, 100), by_text=True)
    sizes = Counter(r.component_id for r in apart.collect())
    assert sizes.pop(None) == 2 and Counter(sizes.values()) == {1: 200, 2: 100}
