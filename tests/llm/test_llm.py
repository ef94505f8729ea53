"""Problems 2, 7, 8, 9 and 10 against brute force, exact round trips and small fixtures."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rainloom.llm import leaks, packing
from rainloom.llm.nearest_time import match_nearest_time
from rainloom.llm.queries import TOKENIZERS
from rainloom.llm.rank_sketch import QUANTILES, RankSketch, TailSketch, day_sketches, merged, percentiles, rank_error
from rainloom.llm.sentences import sentences

T = dt.datetime(1969, 12, 31, 23, 50)


def test_nearest_time_matches_brute_force(spark):
    r = random.Random(1)
    left = [(i, r.randrange(3), T + dt.timedelta(seconds=r.randrange(3000))) for i in range(200)] + [(900, None, T), (901, 1, None)]
    right = [(i, r.randrange(3), T + dt.timedelta(seconds=r.randrange(3000))) for i in range(150)]
    right += [(500 + i, k, t) for i, (_, k, t) in enumerate(right[:30])] + [(990, None, T), (991, 2, None)]
    want = {}
    for i, k, t in left:
        best = min(((abs(u - t), u, j) for j, g, u in right if k is not None and g == k and t and u and abs(u - t) <= dt.timedelta(seconds=180)), default=None)
        if best:
            want[i] = best[2]
    a = spark.createDataFrame(left, "l long, k long, t timestamp_ntz")
    b = spark.createDataFrame(right, "r long, k long, t timestamp_ntz").withColumnRenamed("r", "r_id")
    got = match_nearest_time(a, b, "k", "l", "r_id", "t", "t", 180_000_000).collect()
    assert {x.l: x.r_id for x in got} == want and len(got) == len(want)
    assert match_nearest_time(a.limit(0), b, "k", "l", "r_id", "t", "t", 180_000_000).count() == 0


def test_sketch_error_and_round_trip():
    rng = np.random.default_rng(2)
    v = rng.gamma(0.3, 2, 300_000)
    s = RankSketch()
    for part in np.array_split(v, 37):
        s.merge(RankSketch.load(RankSketch().update(part).dump()))
    assert s.n == len(v) and sum(map(len, s.levels)) < 4_000
    q = [0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]
    rank = np.searchsorted(np.sort(v), s.quantiles(q), "right") / len(v)
    assert all(abs(a - b) <= 2 * rank_error(0.5) * (1 - b) + 2e-5 for a, b in zip(rank, q))
    low = RankSketch(low=True).update(v)
    assert abs((v <= low.quantiles([0.001])[0]).mean() - 0.001) < 2e-4
    few = RankSketch().update(np.array([3.0, 1.0, np.nan, 2.0]))
    assert few.n == 3 and few.quantiles([0, 0.34, 0.5, 1]).tolist() == [1, 2, 2, 3]
    few = TailSketch().update(np.array([3.0, 1.0, np.nan, 2.0]))
    assert few.n == 3 and few.quantiles([0, 0.34, 0.5, 1]).tolist() == [1, 2, 2, 3]
    assert np.isnan(RankSketch().quantiles([0.5])).all() and np.isnan(TailSketch().quantiles([0.5])).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30_000), min_size=1, max_size=8), st.integers(0, 99), st.booleans())
def test_weights_sum_to_the_number_of_values(sizes, seed, low):
    rng = np.random.default_rng(seed)
    whole, both = RankSketch(low=low), TailSketch()
    for n in sizes:
        v = rng.exponential(1, n)
        whole.merge(RankSketch.load(RankSketch(low=low).update(v).dump()))
        both.merge(TailSketch.load(TailSketch().update(v).dump()))
    assert whole.weight() == whole.n == both.n == sum(sizes)
    assert both.sides is None or all(s.weight() == s.n for s in both.sides)


def test_both_tails_of_many_merged_sketches():
    rng = np.random.default_rng(5)
    v = rng.gamma(0.5, 2, 2_000_000)
    s = TailSketch()
    for part in np.array_split(v, 2_000):
        s.merge(TailSketch.load(TailSketch().update(part).dump()))
    assert all(x.weight() == len(v) for x in s.sides)
    q = [*QUANTILES, 0.001, 0.0001, 0.9999]
    rank = np.searchsorted(np.sort(v), s.quantiles(q), "right") / len(v)
    assert all(abs(a - b) <= rank_error(b) + 1e-6 and rank_error(b) <= b for a, b in zip(rank, q)), [(a, b, rank_error(b)) for a, b in zip(rank, q)]


def test_sketches_of_days_merge(spark):
    rng = np.random.default_rng(3)
    rows = [("k", "hot" if rng.random() < 0.7 else f"g{rng.integers(3)}", int(rng.integers(5)), float(x)) for x in rng.exponential(1, 4000)]
    df = spark.createDataFrame(rows + [("k", "hot", 1, None), ("k", "hot", 1, float("nan")), ("k", None, 1, 1.0)], "kind string, key string, day int, value double")
    out = percentiles(merged(day_sketches(df), ["kind", "key"]), [0.5, 0.99]).collect()
    for r in out:
        v = np.array([x[3] for x in rows if x[1] == r.key])
        assert r.n == len(v) and abs((v <= r.value).mean() - r.q) <= r.rank_error + 1 / len(v)
    assert {r.key for r in out} == {"hot", "g0", "g1", "g2"}
    assert percentiles(merged(day_sketches(df.limit(0)), ["kind", "key"])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_is_a_packing(sizes):
    number = packing.pack(np.array(sizes, int), 50)
    fill = np.bincount(number, sizes) if sizes else np.zeros(0)
    assert (number >= 0).all() and (fill <= 50).all() and (fill > 0).all()
    assert len(fill) <= sum(sizes) / 25 + 1


def test_packing_fills_well_and_cuts_only_long_items(spark):
    rng = np.random.default_rng(4)
    sizes = [(i, int(s)) for i, s in enumerate(np.clip(rng.lognormal(5, 1.2, 4000), 1, 9000))]
    x = packing.packed(spark.createDataFrame(sizes + [(5000, 0), (5001, None), (None, 4)], "doc_id long, n_tokens long"), 2048, 2).collect()
    total = {}
    for r in x:
        total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
    assert max(total.values()) <= 2048 and sum(total.values()) == sum(s for _, s in sizes)
    assert sum(total.values()) / 2048 / len(total) > 0.99
    pieces = {}
    for r in x:
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert all(len(p) == -(-dict(sizes)[d] // 2048) for d, p in pieces.items()) and len(pieces) == 4000


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")
def test_token_sizes_sum_to_containers(spark):
    docs = spark.createDataFrame([(1, "rain " * 5000, 0), (2, "", 0), (3, None, 0), (4, "雨量計 <|endoftext|>", 0), (4, "again", 0)], "doc_id long, text string, piece int")
    sizes = {(r.doc_id, r.n_tokens) for r in packing.token_sizes(docs, TOKENIZERS).collect()}
    out = packing.document_containers(docs, TOKENIZERS).collect()
    assert sum(n for _, n in sizes) == sum(r.n_tokens for r in out) and {r.doc_id for r in out} == {1, 4}


PASSAGE = "the old gauge above the northern weir recorded eleven bursts of summer hail before anyone replaced its cracked funnel and nobody remembered where the spare parts had been stored by Müller"
FILLER = "a quite different account of trains and markets follows here without any bearing on the matter at hand whatsoever friends"


def test_leaks(spark):
    w = PASSAGE.split()
    swapped = " ".join("other" if i % 9 == 4 else x for i, x in enumerate(w))
    docs = {
        1: f"{FILLER} {PASSAGE.upper()}. {FILLER}",
        2: f"{FILLER} {swapped} {FILLER}",
        3: f"{' '.join(w[:16])}\n\nAccept all cookies\n\n{FILLER}",
        4: f"{FILLER} {' '.join(w[:6])} {FILLER * 9} {' '.join(w[12:17])}",
        5: FILLER * 50,
        6: "",
        7: None,
        8: PASSAGE.replace("Müller", "M&uuml;ller").replace(" ", "  "),
        9: " ".join(reversed(w)),
        10: "雨量計は北の斜面の貯水池を測ったが、記録装置はまだ動いていないと点検の班が説明した。終わり。",
    }
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "雨量計は北の斜面の貯水池を測ったが、記録装置はまだ動いていないと点検の班が説明した。")]
    d = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, b).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 1), (10, 4)}
    assert leaks.leaked_items(d.limit(0), b).count() == 0 and leaks.leaked_items(d, b.limit(0)).count() == 0


def _unfiltered(item, doc, chars):
    """Share along every diagonal with enough equal tokens, seeds or not."""
    dense, margin = leaks.CHARS if chars else leaks.WORDS
    at = {}
    for j, w in enumerate(doc.tolist()):
        at.setdefault(w, []).append(j)
    n = {}
    for i, w in enumerate(item.tolist()):
        for j in at.get(w, ()):
            n[j - i] = n.get(j - i, 0) + 1
    return leaks.covered(item, doc, np.array([d for d, k in n.items() if k >= min(dense[0], len(item))], int), dense, margin)


def test_leaks_match_an_unfiltered_search(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([6, 15, 34, 80, 200])))) for i in range(40)]
    docs = [(1000, None)]
    for d in range(150):
        w = rng.choice(items)[1].split()
        a = rng.randrange(len(w) // 2 + 1)
        w = w[a : a + rng.randrange(len(w) // 4, len(w) + 1) + 4]
        kind = rng.random()
        w = [x for x in w if rng.random() > 0.06] if kind < 0.3 else ["zz" if k % rng.choice([4, 5, 6, 9]) == 3 else x for k, x in enumerate(w)] if kind < 0.7 else w
        docs.append((d, " ".join(rng.choices(words, k=rng.randrange(200)) + w + rng.choices(words, k=rng.randrange(200)))))
    want = {(d, i) for d, t in docs if t for i, x in items if _unfiltered(leaks.item_tokens(x)[1], leaks.word_ids(leaks.plain(t)), False) >= leaks.SHARE}
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60


def test_long_chains_are_followed_whole():
    item = np.arange(4000, dtype=np.uint64)
    doc = np.concatenate([np.r_[item[a : a + 12], 10_000 + np.arange(6, dtype=np.uint64)] for a in range(0, 4000, 12)])
    at = np.concatenate([np.arange(a // 12 * 18, a // 12 * 18 + 12)[: len(item[a : a + 12])] for a in range(0, 4000, 12)])
    assert leaks.share_of(item, doc, at, np.arange(len(at)), False) > 0.998


CASES = [
    "Dr. Fox saw 3.5 mm at 4 p.m. or later.|It rained, e.g. hail, near www.rain.example.|See fig. 3 and no. 4.|Done!",
    "He left at 5 p.m.|The gauge near Main St. crossing broke.|With R. R. Fox Inc.|Yes…|Why?!|Ok",
    "\"Stay. Now!\" said Ann.|Ann said: \"Go. Run.\"|The end.",
    "« Il pleut. Fort ! » affirme M. Roux.|Il écrit : « Oui. »|La pluie, p. ex. ici, c.-à-d. là.",
    "„Es regnet. Stark!“ sagt Jo.|Am 14. März z. B. war es nass, d. h. kalt.|Ende.",
    "“今天下雨。很大。”有人说，7日，雨停了。|好吗？|好。",
    "他说：“下雨。”|然后停了。",
    "हल्की फुहार 3.5 मि.मी. के बाद डॉ. आए।|\"रुको।\" यह सुनकर वह गया।|ठीक?",
    "يقيس المسجل.|بعد 3.5 مم يخفي؟|«نعم.» هكذا قيل وذهب.",
    "ฝนตก|วันที่ 25 ฝนตก (มาก) วัดได้ 3 มม.จากสถานี|จบ",
    "Home · About · Contact",
    "© 2010 Rain Inc. – All rights reserved.",
    "1. First entry.|Second",
    "Glued.Together here.|Yes",
]


def test_sentences(spark):
    docs = [(i, c.replace("|", "" if "Glued" in c else "" if c[-1] in "。" else " ") if "Glued" not in c else "Glued.Together here. Yes") for i, c in enumerate(CASES)]
    docs += [(90, None), (91, ""), (92, " \n\t "), (93, "  A b.\r\n\r\n c d "), (94, ("Rain fell. " * 3000).strip()), (95, " x. Y 😀. Z")]
    rows = sentences(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, start_pos int")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start_pos)):
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.sentence))
    for i, c in enumerate(CASES):
        want = ["Glued.", "Together here.", "Yes"] if "Glued" in c else c.split("|")
        assert [s for _, _, s in got[i]] == want
    assert [s for _, _, s in got[93]] == ["A b.", "c", "d"] and len(got[94]) == 3000 and not {90, 91, 92} & set(got)
    text = dict(docs)
    for i, units in got.items():
        at = 0
        for a, e, s in units:
            assert text[i][a:e] == s == s.strip() and not text[i][at:a].strip()
            at = e
        assert not text[i][at:].strip()


def test_long_quotations_and_private_characters(spark):
    long = "It rained. " * 20_000
    docs = [
        (1, f"She said “{long}Yes.” and left. The end came."), (2, f"Il a dit « {long}Oui. » hier. Fin."), (3, f'He wrote "{long}Yes." there. The end.'), (4, f"Er rief „{long}Ja.“ laut. Ende."),
        (5, "One \ue001\ue020. Two \ue010 here."), (6, "One \ue001\U000f0005. Two “a. b” here."), (7, "See www." + "a." * 200 + "org now. Then go."), (8, "\ufffd " + long + "Oui. \ufffd dit-il. Fin."),
        (9, " " * 30 + "1. First entry. Second"), (10, "â€œ" + long + "Yes.â€\u009d he said. End."), (11, "ฝน“" + "ตก แล้ว " * 2000 + "”มา จบ"),
    ]
    got = {}
    for r in sorted(sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.start_pos)):
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.sentence))
    text = dict(docs)
    assert all(text[i][a:e] == s for i, units in got.items() for a, e, s in units)
    assert {i: len(u) for i, u in got.items()} == {i: 2 for i in text}
