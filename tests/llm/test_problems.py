"""Operators for training text: definitions, brute force, damaged input, hot groups."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabularium.llm import catalog, fusing, leakage, lookalikes, near_duplicates, neighbours, packing, repetition, scans, site_lines, splitting, words

RNG = np.random.default_rng(1)
VOCABULARY = [f"mot{i}" for i in range(400)]


def text_of(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


# 1


def test_pieces_fit_overlap_and_rejoin(spark):
    texts = [" ".join(["Une phrase assez longue pour couper."] * 200), "x" * 5000, "é\n\n" * 1500, "𝒳" * 2001, "", None, "court", "- item\n" * 700]
    df = spark.createDataFrame([(i, t, f"a{i}", None, True) for i, t in enumerate(texts)], "row_no int, content string, article_number string, part int, was_split boolean")
    out = {}
    for r in splitting.split_oversized(df).collect():
        out.setdefault(r.row_no, []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(out[i], key=lambda r: r.part or 0)
        assert all(r.article_number == f"a{i}" for r in rows)
        if t is None or len(t) <= 2000:
            assert len(rows) == 1 and rows[0].content == t and rows[0].part is None
            continue
        assert [r.part for r in rows] == list(range(1, len(rows) + 1)) and all(len(r.content) <= 2000 for r in rows)
        whole = rows[0].content
        for a, b in zip(rows, rows[1:]):
            assert b.content.startswith(a.content[-100:])
            whole += b.content[100:]
        assert whole == t
    assert all(r.content.rstrip().endswith(".") for r in out[0])


def test_pieces_of_nothing(spark):
    df = spark.createDataFrame([], "row_no int, content string")
    assert splitting.split_oversized(df).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(F.col("content"), 100, 60)


# 2


def test_fused_order_ignores_scale_and_direction(spark):
    rows = [(1, s, f"c{i}", (10 - i) * k + 5) for s, k in (("a", 1.0), ("b", 1000.0)) for i in range(10)] + [(1, "down", f"c{i}", float(i)) for i in range(10)]
    rows += [(1, "a", "none", None), (1, "b", "nan", float("nan")), (2, "a", "only", 3.0), (3, "a", "x", 1.0), (3, "a", "y", 1.0), (4, "a", "inf", float("inf")), (4, "a", "z", 1.0)]
    df = spark.createDataFrame(rows, "g int, s string, i string, x double").withColumn("_g", F.lit("clash"))
    got = fusing.fuse_scores(df, "g", "i", "s", "x", F.col("s") != "down").collect()
    first = sorted((r for r in got if r.g == 1), key=lambda r: -r.fused)
    assert [r.i for r in first] == [f"c{i}" for i in range(10)] and all(0.01 <= r.fused <= 1 for r in got)
    assert {r.i for r in got if r.g == 3 and abs(r.fused - 0.505) < 1e-9} == {"x", "y"}
    assert {r.i for r in got} >= {"only", "inf", "z"} and "none" not in {r.i for r in got}
    assert fusing.fuse_scores(df.limit(0), "g", "i", "s", "x", F.lit(True)).count() == 0


# 3


def test_repeated_lines_follow_the_definition(spark):
    rows = [(i, "hot" if i < 60 else "b", f"c{i}", f"texte propre numero {chr(97 + i % 26)}{chr(97 + i // 26)} ici\n  IMPRIMÉ  le {i}\tdepuis l'espace du bureau\ncourt") for i in range(90)]
    rows += [(200, None, "n", rows[0][3]), (201, "hot", None, rows[0][3]), (202, "hot", "c0", rows[0][3]), (203, "b", "c203", None), (204, "b", "c204", "")]
    df = spark.createDataFrame(rows, "row_no int, filename string, chunk_id string, content string").withColumn("n_removed", F.lit(9))
    got = {(r.row_no, r.line_no) for r in site_lines.repeated_lines(df, "filename", "chunk_id", "content", "row_no").collect()}
    assert got == {(i, 2) for i in [*range(90), 201, 202]}
    clean = {r.row_no: r for r in site_lines.drop_repeated_lines(df, "filename", "chunk_id", "content", "row_no").collect()}
    assert clean[0].content == "texte propre numero aa ici\ncourt" and clean[0].n_removed == 1 and clean[203].content is None and clean[204].content == ""
    assert site_lines.repeated_lines(df.limit(0), "filename", "chunk_id", "content", "row_no").count() == 0


# 4


def vectors_frame(spark, x, ids=None):
    return spark.createDataFrame([(ids[i] if ids else f"v{i:06d}", v, None) for i, v in enumerate(x)], "id string, v array<float>, t timestamp_ntz")


def test_learned_partitions_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((700, 32))
    x = (centres[:, None] + 0.12 * rng.standard_normal((700, 6, 32))).reshape(-1, 32) * rng.lognormal(size=(4200, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    true = {tuple(sorted((i, j))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    df = neighbours.unit_vectors(vectors_frame(spark, x.tolist()), "id", "v", "t", 32)
    index = neighbours.VectorIndex(df, 32, 0.9, part=256)
    assert index.parts > 8 and index.routed(df, index.margin).count() < index.parts * 4200 / 2
    got = {tuple(sorted((int(r.a[1:]), int(r.b[1:])))) for r in index.pairs(5, 0.9).collect()}
    assert len(got & true) / len(true) >= 0.95 and len(got & true) / len(got) >= 0.95


def test_ten_nearest_at_any_cosine(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal((6000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::20] @ unit.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -1
    true = {(20 * i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:10]}
    got = {(r.vec_id, r.other_id) for r in neighbours.p4_vectors(spark, str(tmp_path)).collect()}
    assert len(got) == 3000 and len(got & true) / len(true) >= 0.9


def test_unusable_vectors_and_hot_copies(spark):
    good = [1.0, 0.0, 0.0, 0.0]
    rows = [[*good], [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [1.0], None, [1.0, None, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1e-30, 1e-31, 0.0, 0.0]] + [[0.0, 2.0, 0.0, 0.0]] * 100 + [[0.0, 1.0, 0.01, 0.0]]
    df = neighbours.unit_vectors(vectors_frame(spark, rows), "id", "v", "t", 4)
    assert df.count() == 2 + 101
    pairs = neighbours.VectorIndex(df, 4, 0.9).pairs(5, 0.9).collect()
    assert sum(r.a == "v000008" for r in pairs) >= 99 and any({r.a, r.b} == {"v000000", "v000007"} for r in pairs)
    assert len(pairs) < 500 and neighbours.VectorIndex(df.limit(0), 4, 0.9).pairs(5, 0.9).count() == 0


def test_small_groups_of_copies_fill_the_places(spark):
    x = [[1.0, 0.0]] * 3 + [[1.0, 0.05]] * 2 + [[1.0, 0.1]] * 2
    got = {(r.a, r.b) for r in neighbours.VectorIndex(neighbours.unit_vectors(vectors_frame(spark, x), "id", "v", "t", 2), 2, 0.9).pairs(5, 0.9).collect()}
    assert {("v000000", "v000001"), ("v000000", "v000002"), ("v000001", "v000002"), ("v000003", "v000004"), ("v000005", "v000006")} <= got


def nearest_by_hand(ids, x, k, least, asking):
    """The ``k`` nearest by brute force in double precision: by cosine, then id."""
    x = np.asarray(x, np.float32).astype(float)
    square = np.cumsum(x * x, axis=1)[:, -1]
    out = set()
    for i in asking:
        s = np.clip(np.cumsum(x * x[i], axis=1)[:, -1] / np.sqrt(square * square[i]), -1, 1)
        out |= {(ids[i], ids[j]) for j in sorted((j for j in range(len(x)) if j != i and s[j] >= least), key=lambda j: (-s[j], ids[j]))[:k]}
    return out


def vectors_with_copies(n, dim, seed):
    """Vectors of their own, some with near ones, copies in groups below and above any bound, and the same at other lengths."""
    rng = np.random.default_rng(seed)
    own = rng.standard_normal((n, dim)) + 6 * np.repeat(np.eye(dim)[:2], n // 2, axis=0)
    near = own[: n // 4] + 0.3 * rng.standard_normal((n // 4, dim))
    x = np.concatenate([own, near, np.repeat(own[:3], [70, 200, 20], axis=0), own[5] * np.arange(1, 80)[:, None] / 7]).astype(np.float32)
    return x[rng.permutation(len(x))]


def test_every_link_of_copies_and_of_all_parts_is_met(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED", 20_000)  # several turns
    x = vectors_with_copies(1200, 32, 3)
    ids = [f"{'é' if i % 3 else 'v'}{i:05d}" for i in range(len(x))]
    true = {tuple(sorted(p)) for p in nearest_by_hand(ids, x, 5, 0.9, range(len(x)))}
    index = neighbours.VectorIndex(neighbours.unit_vectors(vectors_frame(spark, x.tolist(), ids), "id", "v", "t", 32), 32, 0.9, part=256)
    got = [tuple(r) for r in index.pairs(5, 0.9).collect()]
    assert index.parts > 4 and len(got) == len(true) and set(got) == true
    asks = neighbours.Nearest(None, x, 6, 0.9, index.w, index.b)
    near, asked = asks.unit @ asks.unit.T >= 0.9, np.zeros((len(x), index.parts), bool)
    for p in range(index.parts):
        asked[asks.reach(p), p] = True
    i, j = np.nonzero(near)
    assert asked[i, asks.own[j]].all() and not asked.all()  # parts are left out, but none that holds a link


def test_ten_nearest_are_whole_with_copies(spark, tmp_path):
    x = vectors_with_copies(1400, 64, 4)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.vec_id, r.other_id) for r in neighbours.p4_vectors(spark, str(tmp_path)).collect()]
    true = nearest_by_hand(range(len(x)), x, 10, -1, range(0, len(x), 20))
    assert len(got) == len(true) == 10 * len(range(0, len(x), 20)) and set(got) == true


# 5


def test_look_alikes_come_out_in_one_form(spark):
    base = "Le régime fiscal de la société à Tunis est réduit. Obtenir un crédit. " * 40 + "الضريبة على الشركة في التونسي كل سنة هنا. " * 40
    bad = {
        1: ("Lе régime", "Le régime"), 2: ("société", "société"), 3: ("ﬁscal", "fiscal"), 4: ("Ｔｕｎｉｓ ２０", "Tunis 20"), 5: ("de la", "de la"), 6: ("ré​gime", "régime"),
        7: ("semi‑fixe", "semi-fixe"), 8: ("الضریبة", "الضريبة"), 9: ("ﻛل", "كل"), 10: ("Оbtenir", "Obtenir"),
    }
    plain = {20: "Le coefficient β vaut 4", 21: "Протокол", 22: "code B12 - semi-fixe", 23: None, 24: "", 25: "👨‍👩 ok"}
    df = spark.createDataFrame([(0, base)] + [(k, v[0]) for k, v in bad.items()] + list(plain.items()), "id int, text string")
    got = {r.id: r for r in lookalikes.consistent_text(df, "id", ["text"]).collect()}
    for k, (_, want) in bad.items():
        assert got[k].text == want and got[k].n_changed > 0, k
    for k, want in plain.items():
        assert got[k].text == want and got[k].n_changed == 0, k
    assert lookalikes.consistent_text(df.limit(0), "id", ["text"]).count() == 0


def test_union_find_is_transitive():
    u = lookalikes.UnionFind()
    u.union("a", "b")
    u.union("c", "b")
    u.union("x", "y")
    assert sorted(sorted(c) for c in u.classes()) == [["a", "b", "c"], ["x", "y"]]


# 6


def brute_pairs(texts, n, least):
    sets = {k: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for k, t in texts.items() if t for w in [re.findall(r"[^\W_]+", t.lower())]}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_shingles_and_classes_do_not_depend_on_the_batch():
    texts = [text_of(40) for _ in range(300)]
    sign = near_duplicates._sign(3, 4, False)
    alone = {}
    for size in (1, 7, 300):
        batches = [pa.record_batch({"_key": pa.array(range(i, min(i + size, 300))), "_text": pa.array(texts[i : i + size])}) for i in range(0, 300, size)]
        got = {r["_key"]: r for out in sign(iter(batches)) for r in out.to_pylist()}
        assert len(got) == 300 and got == (alone := alone or got)
        sets = [near_duplicates._shingles(b.column("_text"), 3) for b in batches]
        assert set(np.concatenate([s[0] for s in sets])) == set(near_duplicates._shingles(pa.array(texts), 3)[0])
    with pytest.raises(ValueError):
        words.distinct_runs(np.zeros(1, np.uint64), np.zeros(1, np.int64), 1 << words.OWNER_BITS)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(60):
        w = text_of(80, rng).split()
        texts[f"a{i}"] = " ".join(w)
        for j in range(int(rng.integers(1, 4))):
            x = list(w)
            for _ in range(int(rng.integers(0, 5))):
                x[int(rng.integers(len(x)))] = "autre"
            texts[f"a{i}_{j}"] = " ".join(x)
    texts |= {"null": None, "empty": "", "two": "un deux"}
    df = spark.createDataFrame([*texts.items(), ("a0", texts["a0"]), ("a1_0", texts["a1_0"])], "id string, text string").withColumn("k1", F.lit("clash")).withColumn("_key", F.lit(1))
    found = near_duplicates.NearDuplicates(df, "id", "text", words=3, similarity=0.5, bands=40)
    rows = found.pairs().collect()
    got, want = {(r.a, r.b) for r in rows}, brute_pairs(texts, 3, 0.5)
    assert len(rows) == len(got)
    assert got <= want and len(got) >= 0.98 * len(want)
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and "null" not in groups and len(groups) == len(texts) - 3


def test_a_third_of_equal_texts_stays_linear(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{i:04d}", "le même texte que tous les autres ont en commun ici") for i in range(300)] + [(f"t{i:04d}", text_of(30, rng)) for i in range(600)]
    found = near_duplicates.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", words=3, similarity=0.5)
    pairs = found.pairs().collect()
    assert len(pairs) == 299 and all(r.a == "h0000" for r in pairs)
    assert len({r.group_id for r in found.groups().where("id LIKE 'h%'").collect()}) == 1
    assert near_duplicates.NearDuplicates(spark.createDataFrame([], "id string, text string"), "id", "text").pairs().count() == 0


def test_sorted_buckets_are_paired_in_any_batches(monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUCKET", 5)
    rng = np.random.default_rng(12)
    band = np.sort(np.concatenate([rng.integers(0, 40, 150), np.full(60, 17), np.full(30, 39)]))
    k = rng.integers(0, 50, len(band))
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(band[i : i + size]), pa.array(k[i : i + size])], names=["band", "k1"]) for i in range(0, len(band), size)]
        pairs, large = set(), {}
        for out in near_duplicates._pair_up(iter(batches)):
            for a, b, is_large in zip(*(c.to_pylist() for c in out.columns)):
                large.setdefault(b, set()).add(a) if is_large else pairs.add((a, b))
        want = set()
        for key in np.unique(band):
            members = sorted({int(x) for x in k[band == key]})
            if len(members) > 5:
                assert large.pop(int(key)) == set(members)
            else:
                want |= {(a, b) for i, a in enumerate(members) for b in members[i + 1 :]}
        assert pairs == want and not large


def test_large_buckets_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUCKET", 8)
    base = text_of(60, np.random.default_rng(6)).split()
    texts = {f"d{i:02d}": " ".join([*base[:50], f"fin{i}", *base[51:]]) for i in range(40)}
    found = near_duplicates.NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text", words=3, similarity=0.5)
    assert {(r.a, r.b) for r in found.pairs().collect()} == brute_pairs(texts, 3, 0.5)


def test_prob_min_hash_estimates_weighted_similarity():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    left, right = a[:200], np.concatenate([a[100:200], b])
    sig = near_duplicates.prob_min_hash(np.concatenate([left, right]), np.repeat([0, 1], 200), np.ones(400), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.04
    weights = np.concatenate([np.where(np.arange(200) >= 100, 3.0, 1.0), np.where(np.arange(200) < 100, 3.0, 1.0)])
    sig = near_duplicates.prob_min_hash(np.concatenate([left, right]), np.repeat([0, 1], 200), weights, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.04


# 7


CLEAN = "Le contribuable verse la retenue au bureau de la commune. La société dépose une déclaration annuelle. Le crédit fiscal réduit la plus-value nette du bailleur minier. "


@pytest.fixture(scope="module")
def repairer(spark):
    return scans.fit_scan_repair(spark.createDataFrame([(CLEAN * 60,), (None,), ("",)], "text string"))


def test_page_numbers_between_whole_sentences_go(repairer):
    for number in ("[776]", "- 654 -", "Page 496", "p.\n681/706", "Page\n12 sur 40"):
        for end, start in ((".", "La"), (":", "La"), ("", "La")):
            assert repairer.furniture([f"La commune verse{end}", *number.split("\n"), f"{start} société dépose"]) == set(range(1, 2 + number.count("\n"))), number
        got, n = repairer.repair(f"La commune verse.\n{number}\nLa société dépose.")
        assert n and got == "La commune verse.\nLa société dépose."
    assert repairer.furniture(["يدفع المكلف.", "[12]", "تودع الشركة."]) == {1}
    for lines in (["La commune verse.", "1998", "La société dépose."], ["12", "- 3 -", "15"], ["Taux | 5.", "12 |", "Base | 7"], ["- 3 -", "La société"], ["La commune p.", "La société"]):
        assert not repairer.furniture(lines)


def test_heads_of_unseen_form_go_by_their_place(repairer):
    for line in ("Bulletin officiel :: page 12", "~ 12 ~", "BULLETIN OFFICIEL • 37"):
        assert not any(p.fullmatch(line) for p in (scans.PAGE, scans.NUMBER)) and not scans.is_head(line)
        lines = ["La commune verse la retenue au", line, "bureau de la commune. La société", "dépose une déclaration"]
        assert repairer.furniture(lines) == {1}, line
        assert repairer.repair("\n".join(lines)) == ("La commune verse la retenue au bureau de la commune. La société dépose une déclaration", 1)
    assert not repairer.furniture(["La commune verse la retenue au", "bureau de la commune. La société", "dépose une déclaration annuelle.", "Le crédit fiscal réduit la"])


def test_furniture_is_learned_on_held_out_pages(repairer):
    rng = np.random.default_rng(77)
    names = sorted(repairer.lexicon)
    pages = [" ".join(rng.choice(names, 80)) + "." for _ in range(40)]
    lessons = scans.furniture_lessons(pages, repairer.lexicon, seed=78)
    model = repairer.furnished
    said = [sum(model.weights.get(f, 0.0) for f in features) > (0 if features[0] == "k1" else model.least) for features, _ in lessons]
    true = [right for _, right in lessons]
    both = sum(a and b for a, b in zip(said, true))
    assert sum(true) > 40 and both / max(sum(said), 1) >= 0.97 and both / sum(true) >= 0.75
    assert scans.furniture_lessons([], repairer.lexicon) == [] and scans.ScanRepair({}, 0).furniture(["a b", "12", "c"]) == set()


def test_traces_of_scans_are_repaired(repairer):
    cases = {
        "la décla-\nration annuelle": "la déclaration annuelle", "la décla¬\n  ration annuelle": "la déclaration annuelle", "la c o m m u n e dépose": "la commune dépose",
        "le c0ntribuable verse": "le contribuable verse", "la s0ciété dép0se": "la société dépose", "le créclit fisca1": "le crédit fiscal", "en 2O14 et l998": "en 2014 et 1998", "la cornmune": "la commune",
        "la société\n[477]\ndépose une": "la société dépose une", "le bailleur\nPage 12 sur 40\nminier": "le bailleur minier", "la société\npage 12 LA RETENUE — UNE COMMUNE\ndépose": "la société dépose",
    }
    for seen, want in cases.items():
        got, n = repairer.repair(seen)
        assert n > 0 and got == want, (seen, got)


def test_clean_text_stays(repairer):
    for t in (CLEAN, "le code B12 et B7", "- une retenue\n- une société", "la plus-\nvalue nette", "Mot | 12 %\nAutre | 13 %", "Протокол β", "x", "", "à y a", "en 2014, 12 % de 1 000"):
        assert repairer.repair(t)[1] == 0, t


def test_marking_misses_nothing_that_repair_finds(repairer):
    texts = ["la décla-\nration", "c o m m u n e", "c0ntribuable", CLEAN, None, "", "le bailleur\n12 |\nminier", "2O14"]
    hit = repairer.marked(pa.array(texts, pa.string()))
    for t, h in zip(texts, hit):
        assert h or not t or repairer.repair(t)[1] == 0


def test_editor_learns_held_out_words(spark, repairer):
    held = scans.lessons_from(repairer.lexicon, 300, seed=99)
    damaged = [(s, "".join(c if label is None else label for c, label in zip(s, labels))) for s, labels in held if any(label is not None for label in labels) and scans.BREAK not in s]
    right = sum(repairer.correct(s) == w for s, w in damaged if s not in repairer.lexicon)
    assert right / sum(s not in repairer.lexicon for s, w in damaged) > 0.85
    out = scans.repair_texts(spark.createDataFrame([(1, "c0mmune", 5), (2, None, 5)], "id int, text string, n_traces int"), repairer).collect()
    assert out[0].text == "commune" and out[0].n_traces == 1 and out[1].text is None


def test_tables_lose_page_rows(repairer):
    text = scans.ROW.join([scans.CELL.join(x) for x in (["la c0mmune", "12"], ["- 658 -", ""], ["122", "5"])])
    assert scans.repair_cells(repairer, text) == (scans.ROW.join([scans.CELL.join(x) for x in (["la commune", "12"], ["122", "5"])]), 2)


# 8


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary here")
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.1'\n\t  sd𝒳", max_size=30), min_size=1, max_size=8))
def test_token_counts_equal_the_tokenizer(texts):
    counter = test_token_counts_equal_the_tokenizer.__dict__.setdefault("counter", packing.TokenCounter(open(packing.VOCABULARY, "rb").read()))
    assert counter.count(pa.array([*texts, None], pa.string())).tolist() == [len(counter.encoding.encode_ordinary(t)) for t in texts] + [0]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_plans_hold_every_item_once(counts):
    got, used = packing.plan(counts, 64), {}
    for pattern, times in got:
        assert times > 0 and sum(k * m for k, m in pattern.items()) <= 64
        for k, m in pattern.items():
            used[k] = used.get(k, 0) + m * times
    assert used == counts
    total, large = sum(k * n for k, n in counts.items()), sum(n for k, n in counts.items() if k > 32)
    assert sum(t for _, t in got) <= 1.5 * max(-(-total // 64), large) + 1  # no two items above half a container share one


def fewest(items, capacity):
    """The least number of containers, by trying all ways."""
    best = [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[i]:
                put(i + 1, [r - items[i] if k == j else r for k, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_come_near_the_least(items):
    counts = {k: items.count(k) for k in items}
    got = packing.plan(counts, 20)
    assert sum(t for _, t in got) <= fewest(sorted(items, reverse=True), 20) + 1


def test_containers_of_several_items_are_emptied():
    loose = [(Counter([6, 5]), 2), (Counter([13]), 2), (Counter([14]), 2), (Counter([3, 2]), 3)]
    got = packing._best_fit(loose, 20)
    assert sum(n for _, n in got) == 6 and all(sum(k * m for k, m in p.items()) <= 20 for p, _ in got)
    held = Counter()
    for p, n in got:
        held.update({k: m * n for k, m in p.items()})
    assert held == Counter({6: 2, 5: 2, 13: 2, 14: 2, 3: 3, 2: 3})
    assert sum(n for _, n in packing._best_fit([(Counter([4, 3]), 1000)], 20)) <= 501


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary here")
def test_packing_assigns_every_token_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "toujours le même texte" if i % 3 == 0 else text_of(int(rng.integers(1, 40)), rng)) for i in range(600)] + [(1000, text_of(900, rng)), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit(1))
    got = packing.pack(df, "doc_id", "text", 256).collect()
    counter = packing.TokenCounter(open(packing.VOCABULARY, "rb").read())
    for i, t in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        n = counter.size(t or "")
        assert sum(r.n_tokens for r in own) == n and [r.start_token for r in own] == [256 * k for k in range(len(own))] and (len(own) == 1 or n > 256)
        assert all((r.container is None) == (n == 0) for r in own)
    filled = {}
    for r in got:
        if r.container is not None:
            filled[r.container] = filled.get(r.container, 0) + r.n_tokens
    assert max(filled.values()) <= 256 and sorted(filled) == list(range(len(filled))) and len(filled) <= sum(filled.values()) / 256 * 1.02 + 1
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# 9


def test_leaks_exact_and_substituted(spark):
    rng = np.random.default_rng(9)
    item = text_of(30, rng)
    w = item.split()
    docs = {1: "avant " + " ".join(w[5:16]) + " après", 2: " ".join(w[:9]), 3: " ".join([*w[:6], "autre", *w[7:13], "encore", *w[14:]]), 4: item.upper().replace("O", "Ó"), 5: None, 6: "", 7: text_of(200, rng)}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("_doc", F.lit("clash"))
    e = spark.createDataFrame([(7, item), (8, None), (9, "trop court"), (10, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert {k for k, r in got.items() if r.longest_run >= 10} == {(i, j) for i in (1, 3, 4) for j in (7, 10)}
    assert got[3, 7].overlap_words >= 26 and got[4, 7].longest_run == 30 and got[1, 7].longest_run == 11
    blocks = leakage.leaks(d, "doc_id", "text", e, "item_id", "text", block_chars=50).collect()
    assert {(r.doc_id, r.item_id): r.longest_run for r in blocks} == {k: r.longest_run for k, r in got.items()}
    assert leakage.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0 and leakage.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0


def test_a_boilerplate_in_many_items_is_taken_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(19)
    shared = text_of(15, rng)
    items = [f"{shared} {text_of(12, rng)}" for _ in range(30)] + [text_of(25, rng) for _ in range(5)]
    docs = [f"{text_of(8, rng)} {shared} {text_of(8, rng)}" for _ in range(40)] + [items[31], " ".join([*items[32].split()[:11], "autre", *items[32].split()[12:]]), text_of(80, rng)]
    index = leakage.SeedIndex(list(range(35)), items)
    flat, bounds = words.word_hashes(pa.array(docs), fold=True)

    def loop(doc, item, diagonal):
        a, b = items[item].split(), docs[doc].split()
        lo = max(0, bounds[doc] - diagonal - index.bounds[item])
        d = int(diagonal - bounds[doc] + index.bounds[item])
        same = [x < len(a) and 0 <= x + d < len(b) and a[x] == b[x + d] for x in range(int(lo), min(len(a), len(b) - d))]
        run = best = now = 0
        overlap = score = equal = 0
        for s in same:
            now = now + 1 if s else 0
            run = max(run, now)
            score, equal = (score + (1 if s else -3), equal + s) if score > 0 else (1 if s else -3, int(s))
            if score > best:
                best, overlap = score, equal
        return run, overlap

    want = None
    for size in (2_000_000, 50):
        monkeypatch.setattr(leakage, "MATCHES", size)
        got = {}
        for doc, item, diagonal in index.hits(flat, bounds):
            for d, i, g, r, o in zip(doc, item, diagonal, *index.verify(flat, bounds, doc, item, diagonal)):
                got[int(d), int(i), int(g)] = (int(r), int(o))
        assert got == {k: loop(*k) for k in got} and len({k[:2] for k, v in got.items() if v[0] >= 10}) >= 40 * 30 + 2
        assert got == (want := want or got)


# 10


def test_labels_compare_the_words(spark):
    rows = [(1, "a b c d e " * 8), (2, text_of(300)), (3, None), (4, ""), (5, "x y"), (6, "Un deux trois quatre cinq! " * 3), (7, "un mot " * 30)]
    df = spark.createDataFrame(rows, "id int, text string")
    exact = {r.id: r.y for r in df.select("id", repetition.exact_label(F.col("text"), 20, 0.2).alias("y")).collect()}
    assert exact == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_the_list_is_right_on_held_out_documents(spark):
    rng = np.random.default_rng(31)
    rows = []
    for i in range(3000):
        w = text_of(60, rng).split()
        again = int(rng.integers(0, 30)) if i % 3 == 0 else 0
        rows.append((i, " ".join([*w, *w[:again]])))
    df = spark.createDataFrame(rows, "id int, text string")
    stats = repetition.repetition_statistics(df, "id", "text").cache()
    rules, labelled = repetition.fit_repetition_list(df, stats, "id", "text", 20, 0.2, sample_rows=400)
    assert 300 < len(labelled) < 1500
    said = {r.id for r in stats.where(repetition.as_condition(rules) > 0).collect()}
    true = {r.id for r in df.where(repetition.exact_label(F.col("text"), 20, 0.2)).collect()}
    assert len(said & true) >= 0.99 * len(true) and len(said & true) >= 0.99 * len(said) and len(true) > 100


def test_repetition_statistics(spark):
    rows = [(1, "a b c d e " * 8), (2, text_of(300)), (3, None), (4, ""), (5, "x\nx\nx")]
    got = {r.id: r for r in repetition.repetition_statistics(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got[1].n_words == 40 and got[1].rep_run5 == pytest.approx(1 - 5 / 36) and got[3].n_words == 0 and got[4].rep_run5 == 0 and got[5].rep_line == pytest.approx(2 / 3)


def test_decision_lists_learn_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.7) & (x[:, 1] > 0.4)) | (x[:, 2] > 0.95)
    rules = repetition.learn_decision_list(x, y)
    test = rng.random((4000, 3))
    said = np.zeros(4000, bool)
    for rule, precision in rules:
        said |= repetition._holds(rule, test)
    assert (said == (((test[:, 0] > 0.7) & (test[:, 1] > 0.4)) | (test[:, 2] > 0.95))).mean() > 0.98 and 1 <= len(rules) <= 6


def test_repetitive_documents(spark):
    rows = [(i, text_of(60)) for i in range(200)] + [(1000 + i, "toujours la même phrase ici encore " * (3 + i % 5)) for i in range(60)] + [(1, None), (2, ""), (3, "un deux")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = repetition.repetitive(df, "id", "text")
    assert {r.id for r in got.where("verdict > 0").collect()} == {1000 + i for i in range(60) if i % 5}  # others have under 20 words
    assert repetition.repetitive(df.limit(0), "id", "text").count() == 0
    assert repetition.repetitive(df.where("id < 200"), "id", "text").where("verdict > 0").count() == 0


# shared


def test_word_hashes_agree_with_a_plain_loop():
    texts = ["Été, l'ÉTÉ 12!", None, "", "  a--b  ", "x" * 10]
    flat, bounds = words.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(bounds).tolist() == [4, 0, 0, 2, 1] and flat[0] == flat[2]
    folded, _ = words.word_hashes(pa.array(["été été ete"]), fold=True)
    assert folded[0] == folded[1] == folded[2]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from tools.compare import TABLES, norm

    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    oracle = catalog.oracle_sql()
    for name, query in catalog.queries().items():
        df = query(spark, root)
        cols = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        if name in oracle:
            cur = con.execute(oracle[name])
            have = [d[0] for d in cur.description]
            assert sorted((tuple(norm(dict(zip(have, r))[c]) for c in cols) for r in cur.fetchall()), key=repr) == got, name
