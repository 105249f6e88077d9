"""The operators of tessitura.llm, against plain Python, public encoders and held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from math import log
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import cooccur, lookalike, packing
from tessitura.llm.cooccur import cooccurrence
from tessitura.llm.encode import VOCABULARY, BytePairEncoder, count_tokens, encode, read_ranks
from tessitura.llm.lookalike import Trie, consistent, consistent_form, glyphs, normal_form, same_look, signs
from tessitura.llm.packing import best_fit_decreasing, pack
from tessitura.llm.residue import ResidueModel, _named, _SIZE, _PLACE, _Vocabulary, find_residue, places, sentences, stretches, tokens, train_residue_model, weak_label
from tessitura.operators import stripes

BASKETS = "kind string, items array<string>, n long"


def plain_pairs(baskets: list[tuple], least: int, ratio: float) -> set[tuple]:
    pairs, items, n = Counter(), Counter(), Counter()
    for kind, some, _ in baskets:
        mine = sorted({x for x in some or [] if x is not None}, key=lambda x: x.encode())
        if kind is not None and mine:
            n[kind] += 1
            items.update((kind, x) for x in mine)
            pairs.update((kind, *p) for p in combinations(mine, 2))
    return {(k, a, b, c) for (k, a, b), c in pairs.items() if c >= least and c * n[k] >= ratio * items[k, a] * items[k, b]}


def random_baskets(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        some = [f"i{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 12))] + ["everywhere"] * (rng.random() < 0.9) + [None] * (rng.random() < 0.2)
        out.append((rng.choice(["q", "q", "s", None]), rng.choice([some, some, some, None, []]), 1))
    return out


@pytest.mark.parametrize(("least", "ratio"), [(1, 0.5), (2, 1), (3, 2), (5, 5)])
def test_pairs_match_plain_counting(spark, least, ratio):
    baskets = random_baskets(least, 600)
    found = cooccurrence(spark.createDataFrame(baskets, BASKETS).repartition(5), min_count=least, min_ratio=ratio)
    assert {(r["kind"], r["item_a"], r["item_b"], r["n_ab"]) for r in found.collect()} == plain_pairs(baskets, least, ratio)


def test_pairs_in_small_parts_change_nothing(spark, monkeypatch):
    baskets = [*random_baskets(9, 300), ("q", [f"i{i}" for i in range(150)], 1), ("q", [f"i{i}" for i in range(100, 260)], 1)]
    for name, value in (("PAIRS_AT_ONCE", 500), ("ROW_ENTRIES", 3), ("HELD_ENTRIES", 10)):
        monkeypatch.setattr(stripes, name, value)
    found = cooccurrence(spark.createDataFrame(baskets, BASKETS), min_count=2, min_ratio=1)
    assert {(r["kind"], r["item_a"], r["item_b"], r["n_ab"]) for r in found.collect()} == plain_pairs(baskets, 2, 1)


def test_log_likelihood_ratio_and_nothing(spark):
    r = spark.range(1).select(cooccur.log_likelihood_ratio(*(F.lit(x) for x in (10, 20, 30, 1000))).alias("x")).first()["x"]
    k = [[10, 10], [20, 960]]
    x = sum(c * log(c) for row in k for c in row) - sum(sum(row) * log(sum(row)) for row in k) - sum(sum(c) * log(sum(c)) for c in zip(*k)) + 1000 * log(1000)
    assert r == pytest.approx(2 * x)
    assert cooccurrence(spark.createDataFrame([], BASKETS)).count() == 0


SAME = [("Trio", "Тrіo"), ("Trio", "Ｔｒｉｏ"), ("a b", "a b"), ("a-b", "a‑b"), ("Oﬃce", "Office"), ("é", "é"), ("T​r­io﻿", "Trio"), ("  Trio\t", "Trio"), ("ガ", "ｶﾞ"), ("Чарноба", "Чapнoбa"), ("K", "K"), ("Zoo", "Ζοο")]
DIFFERENT = [("Trio", "trio"), ("e", "é"), ("a  b", "a b"), ("l", "I"), ("0", "O"), ("ab", "a b"), ("n", "ñ"), ("カ", "ガ"), ("x²", "x2"), ("Trio", "Trios")]


def test_looks():
    assert all(glyphs(a) == glyphs(b) and normal_form(a) == normal_form(b) for a, b in SAME)
    assert all(glyphs(a) != glyphs(b) and normal_form(a) != normal_form(b) for a, b in DIFFERENT)
    assert normal_form("Чapнoбa") == "Чарноба" and normal_form("Ｔrіo") == "Trio" and normal_form("") == ""


def test_trie_costs():
    words = ["Salt", "Salty", "Malt", "Ѕаlt"]
    trie = Trie(words)

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("SMaltyх") for _ in range(rng.randrange(8)))
        for budget in (0, 1, 2):
            found = {trie.spellings[e][0]: c for c, e in trie.find(text, budget)}
            assert found == {w: d for w in words[:3] if (d := edits(glyphs(text), glyphs(w))) <= budget}
    assert trie.canonical(trie.find("Salt")[0][1]) == "Salt" and consistent("Sált", trie) == "Sált" and consistent("Ｓalt", trie) == "Salt"


def test_same_look_both_ways(spark, monkeypatch):
    texts = [(i, t, "x") for i, t in enumerate([a for p in SAME + DIFFERENT for a in p])] + [(900, None, "x"), (901, "", "x"), (902, "​", "x"), (903, "x" * 100_000, "x")]
    texts += texts[:5]
    names = [(100 + i, b, None) for i, (_, b) in enumerate(SAME)] + [(200, None, None), (201, "", None)]
    t, n = spark.createDataFrame(texts, "id long, name string, ref string"), spark.createDataFrame(names, "ref long, name string, id string")
    wanted = sorted({(i, r) for i, a, _ in texts for r, b, _ in names if a and b and a != b and glyphs(a) and glyphs(a) == glyphs(b)})
    assert len(wanted) >= len(SAME)
    plain = {i: (a if a is None or not glyphs(a) else consistent(a, Trie([b for _, b, _ in names if b]))) for i, a, _ in texts}
    for most in (100_000, 2):
        monkeypatch.setattr(lookalike, "SENT_NAMES", most)
        assert sorted(tuple(r) for r in same_look(t, "id", "name", n, "ref", "name").collect()) == wanted
        assert same_look(t.limit(0), "id", "name", n, "ref", "name").count() == 0 == same_look(t, "id", "name", n.limit(0), "ref", "name").count()
        form = {r["id"]: r["name"] for r in consistent_form(t, "name", n, "name", "name").collect()}
        assert form[900] is None and form[901] == "" and all(form[i] == x for i, x in plain.items() if x and glyphs(x))
        assert consistent_form(t, "name", n.limit(0), "name", "form").where("id = 1").first()["form"] == normal_form(texts[1][1])


def test_signs_walk_as_glyphs_fold():
    rng = random.Random(11)
    marks = ["e", "é", "\u0301", "\u0323", "е", "ё", "ﬃ", "Ａ", "ｶ", "ﾞ", "ガ", " ", "\u00a0", "\u200b", "\u00ad", "‐", "—", "Ζ", "각", "ạ̈", "\ufe0f", "x"]
    for _ in range(4_000):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(9)))
        assert "".join(signs(text)) == glyphs(text), ascii(text)


def test_sql_of_looks_tells_the_same():
    duckdb = pytest.importorskip("duckdb")
    texts = [x for p in SAME + DIFFERENT for x in p]
    looks = {t: duckdb.execute(f"SELECT {lookalike.look_sql('x')} FROM (SELECT ? AS x)", [t]).fetchone()[0] for t in texts}
    assert all((looks[a] == looks[b]) == (glyphs(a) == glyphs(b)) for a in texts for b in texts)


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(read_ranks(Path(VOCABULARY).read_text()))


def test_encoder_equals_the_public_one(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    public.encode_special_tokens = True
    rng = random.Random(2)
    marks = ["a", "ab", "the", " ", "\n", "é", "日本", "🎧", "<|endoftext|>", "'s", "​", "aaaa", "0", "12", "--", "==", "\t", "ing", "́"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(32, 0x3000)])) for _ in range(50)) for _ in range(500)]
    texts += ["", " ", "a" * 20_000, "ab" * 9_000, "".join(rng.choice("ethr") for _ in range(20_000))]
    for text in texts:
        assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_encode_table(spark, encoder):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (1, "Hello world", "x"), (None, "b", "x"), (6, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    found = sorted((r["id"] or 0, list(r["ids"])) for r in encode(df, "id", "text").collect())
    assert found == sorted((i or 0, encoder.encode(t) if t else []) for i, t, _ in rows)
    assert sorted(r["size"] for r in count_tokens(df, "id", "text").collect()) == sorted(len(x) for _, x in found)
    assert encode(df.limit(0), "id", "text").count() == 0


def plain_best_fit(sizes: list[int], capacity: int) -> Counter:
    room: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        best = min(fits, key=lambda i: room[i], default=None)
        room.append(capacity - s) if best is None else room.__setitem__(best, room[best] - s)
    return Counter(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([1, 2, 7, 64, 100])
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.7 else max(1, capacity // 3) for _ in range(rng.randrange(200))]
        plan = best_fit_decreasing(Counter(sizes), capacity)
        load = Counter()
        for s, b in zip(sorted(sizes, reverse=True), packing.place(plan.table(), np.arange(len(sizes))) if sizes else []):
            load[int(b)] += s
        assert Counter(capacity - x for x in load.values()) == plain_best_fit(sizes, capacity)


def test_pack_table(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 50, 50, 50, 70, 99, 100, 101, 250, 1000, None, -3]), "x", "y") for i in range(700)] + [(5, 60, "x", "y")] * 2 + [(None, 8, "x", "y")]
    df = spark.createDataFrame(rows, "id long, size long, bin string, part string")
    found = pack(df.repartition(6), "id", "size", 100).collect()
    load, items = Counter(), Counter()
    for r in found:
        load[r["bin"]] += r["size"]
        items[r["id"]] += r["size"]
    assert max(load.values()) <= 100
    wanted = Counter()
    for i, size, *_ in rows:
        wanted[i] += max(size or 0, 0)
    assert items == wanted
    parts = [100] * sum((s or 0) // 100 for _, s, *_ in rows if (s or 0) > 0) + [s % 100 for _, s, *_ in rows if (s or 0) > 0 and s % 100]
    assert len([x for x in load.values() if x]) == sum(plain_best_fit(parts, 100).values())
    assert all(r["part"] == 0 or r["size"] > 0 for r in found) and len(found) == len(parts) + sum((s or 0) <= 0 for _, s, *_ in rows)
    monkeypatch.setattr(packing, "ITEMS_AT_ONCE", 40)
    salted = Counter()
    for r in pack(df.repartition(6), "id", "size", 100).collect():
        salted[r["bin"]] += r["size"]
    assert Counter(salted.values()) == Counter(load.values())  # many salts, as good a result
    monkeypatch.undo()
    again = pack(df.repartition(2), "id", "size", 100).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert pack(df.limit(0), "id", "size", 100).count() == 0


CONTENT = ["The crowd knew every word.", "She sings close to the microphone.", "Most of the album was recorded at night near {}.", "The single is called Error 404, and the joke wears off.", "A whole verse is built from the phrase \"access denied to you\", sung twice."]
RESIDUE = ["Access denied.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "404 Not Found", "{{{{ artist }}}} grew up in {}.", "Something went wrong on our end.", "asdf jkl; asdf qwerty fghj"]


def test_residue_on_unseen_hosts(spark):
    rng = random.Random(5)
    docs, truth = [], set()
    for i in range(1500):
        parts = [rng.choice(CONTENT).format(f"Town{i}") for _ in range(rng.randrange(1, 5))]
        if i % 6 == 0:
            truth.add(i)
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(RESIDUE).format(f"Town{i}"))
        docs.append((i, "\n".join(parts), f"host{i % 40}", 1.0))
    docs += [(9000, None, None, 1.0), (9001, "", None, 1.0), (9002, " \n ​", None, 1.0), (9003, "word " * 60_000, "host1", 1.0), docs[0]]
    df = spark.createDataFrame(docs, "id long, text string, host string, score double")
    model = train_residue_model(df, "id", "text", "host")
    assert model.validation["f1"] > 0.95
    found = [r["id"] for r in find_residue(df, "id", "text", model).collect()]
    hits = set(found)
    assert len(hits & truth) >= 0.97 * len(truth) and len(hits - truth) <= 3 and not hits & {9000, 9001, 9002, 9003} and found.count(0) == 2
    nothing = train_residue_model(df.limit(0), "id", "text", "host")
    assert find_residue(df, "id", "text", nothing).count() == 0 == find_residue(df.limit(0), "id", "text", model).count()


def test_sentences_and_labels():
    assert sentences("<p>One two.</p>\r\nThree\u200b four! Five") == ["One two.", "Three four!", "Five"]
    assert weak_label("Hi {{name}},") == weak_label("HTTP 503 Service Unavailable") == weak_label("エラーが発生しました。") == weak_label("asdf qwerty blah blah") == weak_label("text text text") == 1
    assert weak_label("The single is called Access Denied.") == weak_label("A name in braces, such as `{{name}}`, is replaced.") == weak_label("She refuses to enable JavaScript.") == -1
    assert weak_label("A quiet week: 403 streams.") == 0 and weak_label("The band from the harbour town says in a long letter from June that the page was not found.") in (-1, 2)


def test_windows_reach_all_along_a_sentence():
    long = "many quiet words follow here without an end " * 40 + "Access denied by the server " + "and more quiet words come after it " * 40
    made = tokens([long, "Short one.", "あいうえおかきくけこさしすせそたちつてと"], _Vocabulary())
    at, to, of = stretches(made)
    assert at[:3].tolist() == made.begin.tolist() and to[:3].tolist() == made.end.tolist() and (to > at).all() and (of[3:] != 1).all()
    assert all(made.begin[s] <= a and b <= made.end[s] for a, b, s in zip(at, to, of))
    words = long.split()
    assert any(at[i] == 1 + words.index("Access") and to[i] == at[i] + 6 for i in np.flatnonzero(of == 0))
    kana = {int(a) for a, s in zip(at, of) if s == 2}
    assert len(kana) > 12  # every sign may start one


def test_scores_add_up_the_weights_of_each_stretch():
    rng = np.random.default_rng(3)
    model = ResidueModel(rng.standard_normal(1 << 18).astype(np.float32), 0.25, {})
    texts = ["One two three four five six seven eight nine Ten eleven twelve thirteen {{ a }} fourteen", "Only this.", None, "", " \n", "Same.\nSame.\nOther words here"]
    for text, score in zip(texts, model.scores(texts)):
        parts = sentences(text) if text else []
        if not parts:
            assert score == -np.inf
            continue
        made = tokens(parts, _Vocabulary())
        at, to, of = stretches(made)
        where, best = places([parts]), -np.inf
        for i, (a, b, s) in enumerate(zip(at, to, of)):
            features = [g[k] for reach, group in enumerate(made.grams) for g in group for k in range(a, b - reach) if g[k] >= 0]
            features += [*_PLACE[where[s]][: 4 if i < len(parts) else 2], _SIZE[min(int(np.log2(b - a + 1)), 9)], *([] if i < len(parts) else [_named("window")])]
            best = max(best, model.bias + sum(float(model.weights[f]) for f in features))
        assert score == pytest.approx(best, abs=1e-6)


#: Written without regard to the phrases of the labels and to the test texts.
SERVED = """Internal Server Error
Please verify you are human to proceed.
Service is currently offline, check back shortly.
Curabitur pretium tincidunt lacus nulla gravida orci.
The page you requested could not be found on our servers.
You must be signed in to listen to this mix.
This account has been suspended.
Sorry, you have been blocked.
We are performing scheduled maintenance and will return soon.
HTTP ERROR 500
502 Bad Gateway
Oops! That page can't be found.
Your connection was interrupted, please retry.
Enable cookies and JavaScript to continue.
This content requires JavaScript to be enabled.
Insert headline here
Your description goes in this area, click to edit.
[Artist biography to be added]
Dear {{ first_name }}, thank you for listening.
Welcome back, ${user.name}!
Hello %FIRSTNAME%, here is your recap.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere.
foo bar baz qux
asdkjh asdf lkjh qwer
ValueError: invalid literal for int() with base 10
java.lang.NullPointerException at com.example.App.main(App.java:14)
{"code": 403, "message": "Forbidden"}
Authentication required. Please log in.
Your free trial has expired.
Quota exceeded for this project.
Unable to load the player.
Video unavailable
No se ha podido cargar la página, inténtalo más tarde.
Debes iniciar sesión para ver este contenido.
Cette page n'est plus disponible.
Vous devez activer JavaScript dans votre navigateur.
Diese Seite ist leider nicht erreichbar.
Sie müssen sich anmelden, um fortzufahren.
Não foi possível carregar o conteúdo.
A sua sessão expirou, faça login novamente.
Сервер временно недоступен, попробуйте позже.
Для работы сайта включите JavaScript.
サーバーに接続できませんでした。
ログインが必要です。""".split("\n")
TOLD = """The guitarist forgot the words and nobody minded.
Their third single, Page Not Found, was a modest hit.
He called the tour Access Denied because the venue kept them waiting.
She says the website asked her to enable JavaScript and she gave up.
The drummer had a session at noon and another at six.
The error in the second verse was left in on purpose.
Permission to record in the church came late.
The band will be back in spring with a new singer.
I try again and again to like this record.
A server at the bar told us the set would start late.
The service was slow but the sound was excellent.
In the liner notes the words "lorem ipsum" stand where a dedication should be.
The chorus counts from 400 to 404 and stops.
She found the page of lyrics in an old book.
Our team of reviewers liked the demo best.
The script for the musical was written in two weeks.
They required three takes and a lot of coffee.
The title track is a test of patience.
A sample of birdsong opens the album.
La página del libro estaba llena de notas.
El error fue grabar la voz al final.
Le groupe a joué une page de Satie en rappel.
Der Fehler im Takt macht das Lied sympathisch.
Die Seite B ist besser als die Seite A.
A sessão de gravação durou a noite inteira.
Ошибка в тексте стала шуткой группы.
アルバムの最後のページに歌詞がある。
We could not find a better closing song this year.
The venue was closed for repairs, so they played outside.
Please yourself, sings the choir, and the organ agrees.""".split("\n")


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data here")
def test_residue_in_other_words(spark):
    model = train_residue_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id", "text", "source")
    served, told = model.scores(SERVED) >= 0, model.scores(TOLD) >= 0
    print("recall", served.mean(), "precision", served.sum() / (served.sum() + told.sum()))
    assert served.mean() >= 0.8 and served.sum() >= 0.9 * (served.sum() + told.sum()) and model.validation["f1"] > 0.95
