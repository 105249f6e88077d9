"""One form for text that looks the same: tables of look-alikes, tries of known spellings, and an automaton over them."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts with the shape of a Latin letter, in pairs. Accented letters are decomposed first.
CYRILLIC = "А A В B Е E К K М M Н H О O Р P С C Т T У Y Х X Ѕ S І I Ј J Ү Y Ԛ Q Ԝ W Ӏ I Ѵ V Ԍ G а a е e о o р p с c у y х x ѕ s і i ј j һ h ԁ d ԛ q ԝ w ӏ l ѵ v ү y ԍ G"
GREEK = "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J ο o ν v ρ p ϲ c ϳ j"
OTHER_SCRIPTS = "Օ O օ o Ս U ս u Լ L հ h ո n ց g զ q Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꭱ R Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z"
#: Kinds of hyphen, all written as "-". The em dash is longer and stays.
HYPHENS = "‐‑‒–−˗⁃﹣－"
#: Joined letters that Unicode decomposes as compatible; other compatible forms (superscripts, fractions) look different.
JOINED = "ﬀﬁﬂﬃﬄﬅﬆĲĳǇǈǉǊǋǌǱǲǳǄǅǆﬓﬔﬕﬖﬗ"
#: Invisible although not of category Cf: fillers, joiners and variation selectors.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85⠀"


def _pairs(line: str) -> dict[str, str]:
    marks = line.split()
    return dict(zip(marks[::2], marks[1::2]))


SHAPES = _pairs(CYRILLIC) | _pairs(GREEK) | _pairs(OTHER_SCRIPTS)


def _spelled(char: str) -> str:
    """Without width and joins; "" for what can't be seen. Rules over Unicode's data, with the tables above."""
    kind = unicodedata.category(char)
    if char in BLANKS or kind in ("Zs", "Zl", "Zp"):
        return " "
    if char in HYPHENS:
        return "-"
    if kind in ("Cf", "Cc") or char in INVISIBLE:
        return ""
    form = unicodedata.decomposition(char)
    if form.startswith(("<wide>", "<narrow>", "<noBreak>")) or char in JOINED:
        return "".join(_spelled(chr(int(x, 16))) for x in form.split() if x[0] != "<")
    return char


class _Spelling(dict):
    def __missing__(self, code: int) -> str:
        self[code] = found = _spelled(chr(code))
        return found


_SPELLING, _SHAPE = _Spelling(), {ord(a): b for a, b in SHAPES.items()}


def glyphs(text: str) -> str:
    """What is seen of a text, accents apart from their letters and every letter in one script.

    Two texts look the same if and only if their glyphs are equal: what the automaton decides without making them.
    """
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    apart = unicodedata.normalize("NFD", text.translate(_SPELLING))
    return apart.translate(_SHAPE).strip(" ")


def normal_form(text: str) -> str:
    """By the tables alone: seen form with accents composed. A text all in one other script keeps that script's letters.

    Cyrillic, Greek and other letters are written in Latin only where Latin or ambiguous letters stand around them,
    so that a word in such a script, of which some letters were exchanged, comes out in that script again.
    """
    seen = unicodedata.normalize("NFC", text.translate(_SPELLING)).strip(" ")
    if seen.isascii():
        return seen
    return " ".join(_one_script(word) for word in seen.split(" "))


_TO_SCRIPT = {"CYRILLIC": {v: k for k, v in reversed(_pairs(CYRILLIC).items())}, "GREEK": {v: k for k, v in reversed(_pairs(GREEK).items())}}


def _one_script(word: str) -> str:
    letters = unicodedata.normalize("NFD", word)
    own = Counter(s for c in letters if c not in SHAPES and c.isalpha() and (s := unicodedata.name(c, "?").split()[0]) in _TO_SCRIPT)
    plain = Counter(c for c in letters if c.isascii() and c.isalpha())
    script = own.most_common(1)[0][0] if own else ""
    if script and all(c in _TO_SCRIPT[script] for c in plain):
        change = {ord(k): v for k, v in _TO_SCRIPT[script].items()}
        return unicodedata.normalize("NFC", letters.translate(_SHAPE).translate(change))
    if own:
        return word
    return unicodedata.normalize("NFC", letters.translate(_SHAPE))


class _Edges(dict):
    """What a character of a text can do for nothing: the signs it stands for, as (order of the mark, sign), where a
    look-alike stands for the sign of its class, a joined letter for several, and an ignorable for none (it stays)."""

    def __missing__(self, char: str) -> tuple[tuple[int, str], ...]:
        apart = unicodedata.normalize("NFD", char.translate(_SPELLING))
        self[char] = found = tuple((unicodedata.combining(c), c.translate(_SHAPE)) for c in apart)
        return found


_EDGES = _Edges()


def signs(text: str) -> Iterator[str]:
    """The signs along a text's free edges, one after the other. Marks that stand in a row come in their canonical order;
    blanks come with the next sign, so that those at either end never do."""
    edges, marks, blanks, begun = _EDGES, [], 0, False
    for char in text:
        for order, sign in edges[char]:
            if order:
                marks.append((order, sign))
                continue
            if marks:
                if blanks:
                    yield from " " * blanks
                    blanks = 0
                yield from (m for _, m in sorted(marks, key=lambda m: m[0]))
                marks, begun = [], True
            if sign == " ":
                blanks += begun
                continue
            if blanks:
                yield from " " * blanks
                blanks = 0
            begun = True
            yield sign
    if marks:
        yield from " " * blanks
        yield from (m for _, m in sorted(marks, key=lambda m: m[0]))


class Trie:
    """Known spellings by their signs. A node is a dict from sign to node; under "" it holds the end's number."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        self.spellings: list[list[str]] = []
        for word in words:
            node = self.root
            for sign in signs(word):
                node = node.setdefault(sign, {})
            if node is self.root:
                continue  # of such a word nothing is seen
            if "" not in node:
                node[""] = len(self.spellings)
                self.spellings.append([])
            self.spellings[node[""]].append(word)

    def canonical(self, end: int) -> str:
        """Of the spellings of one look the most frequent; of equals the one in normal form, then the smallest."""
        counts = Counter(self.spellings[end])
        return min(counts, key=lambda w: (-counts[w], w != normal_form(w), w))

    def find(self, text: str, budget: int = 0) -> list[tuple[int, int]]:
        """(cost, end) of the spellings within budget, cheapest first.

        The weighted edit automaton runs down the trie over the characters of the text as they are. Its states are nodes
        with the cost so far. An ignorable stays where it is at cost 0; a step to the sign of a character's class costs
        0 whatever its spelling; another, a missing and a surplus sign cost 1. No state within budget ends the walk.
        """
        states: dict[int, tuple[int, dict]] = {}

        def put(into: dict[int, tuple[int, dict]], cost: int, node: dict) -> None:
            todo = [(cost, node)]
            while todo:
                c, at = todo.pop()
                if c > budget or (id(at) in into and into[id(at)][0] <= c):
                    continue
                into[id(at)] = (c, at)
                if c < budget:
                    todo += [(c + 1, child) for sign, child in at.items() if sign]

        put(states, 0, self.root)
        for sign in signs(text):
            after: dict[int, tuple[int, dict]] = {}
            for cost, node in states.values():
                if sign in node:
                    put(after, cost, node[sign])
                if cost < budget:
                    put(after, cost + 1, node)
                    for other, child in node.items():
                        if other and other != sign:
                            put(after, cost + 1, child)
            states = after
            if not states:
                return []
        return sorted((cost, node[""]) for cost, node in states.values() if "" in node)


def consistent(text: str, trie: Trie, budget: int = 0) -> str:
    """The canonical spelling if the trie has the text, else its normal form."""
    found = trie.find(text, budget)
    return trie.canonical(found[0][1]) if found else normal_form(text)


def _each(values: pa.Array, once) -> list:
    """once() of each different value, in the order of values; null stays None."""
    coded = values.dictionary_encode()
    made = [once(x) for x in coded.dictionary.to_pylist()]
    return [None if i is None else made[i] for i in coded.indices.to_pylist()]


#: A vocabulary of so many names, of so many characters in all, is sent to every task as one trie; larger ones are cut up.
SENT_NAMES, SENT_CHARACTERS = 100_000, 8_000_000
#: Tries of a larger vocabulary are made for names that share so many first signs, and their number of signs.
SHARED_SIGNS = 8


def _sent(spark: SparkSession, names: DataFrame, column: str):
    """The different rows of names as a broadcast list, or None if they are more than may be sent."""
    size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("c")).first()
    if size["n"] > SENT_NAMES or size["c"] > SENT_CHARACTERS:
        return None
    return spark.sparkContext.broadcast(sorted(tuple(r) for r in names.collect()))


def _part(values: pd.Series) -> pd.Series:
    """Which trie a text belongs to: its first signs and how many it has; null if none is seen."""

    def one(text: str | None) -> str | None:
        found = list(signs(text)) if text is not None else []
        return f"{len(found)} {''.join(found[:SHARED_SIGNS])}" if found else None

    return values.map(one).astype(object)


def _walk_in_parts(texts: DataFrame, names: DataFrame, answers, kind: str) -> DataFrame:
    """(text, answer) for a vocabulary of any size: answers(trie, text) of each different text.

    Texts that look like a name share its first signs and number of signs, so both sides are shuffled by these, and a
    task makes a trie of the names of one such part after the other and walks that part's texts through it.
    """
    part = F.pandas_udf(_part, "string")
    both = names.select(F.lit(0).alias("side"), F.col("name").alias("text")).unionByName(texts.select(F.lit(1).alias("side"), "text").distinct())
    laid = both.withColumn("part", part("text")).where("part is not null").repartition("part").sortWithinPartitions("part", "side")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, trie = None, [], None
        for batch in batches:
            out = []
            for at, side, text in zip(batch["part"].to_pylist(), batch["side"].to_pylist(), batch["text"].to_pylist()):
                if at != now:
                    now, words, trie = at, [], None
                if side == 0:
                    words.append(text)
                elif words:
                    trie = trie or Trie(words)
                    out += [(text, x) for x in answers(trie, text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["text", "answer"])

    return laid.mapInArrow(walk, f"text string, answer {kind}")


def consistent_form(df: DataFrame, column: str, names: DataFrame, name: str, into: str, *, budget: int = 0) -> DataFrame:
    """df with `into`: the canonical spelling of the vocabulary for texts that look like it, else the normal form.

    A vocabulary that may be sent goes to every task as one trie, and there is no shuffle: each batch looks up its
    different texts once. A larger one is cut into tries by first signs, where different texts are looked up and joined
    back; it allows no edits (budget 0). Null stays null, empty stays empty; a column of the name `into` is replaced;
    other columns pass through; null names are left out, and the count of a repeated name makes its spelling canonical.
    """
    words = names.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"))
    sent = _sent(df.sparkSession, words, "name")
    if sent is not None:

        @F.pandas_udf("string")
        def form(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = Trie(w for (w,) in sent.value)
            for series in values:
                yield pd.Series(_each(pa.array(series, pa.string()), lambda x: consistent(x, trie, budget)), dtype=object)

        return df.withColumn(into, form(F.col(column).cast("string")))
    if budget:
        raise ValueError("a vocabulary in parts is looked up without edits")

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return pd.Series(_each(pa.array(values, pa.string()), normal_form), dtype=object)

    texts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("text"))
    found = _walk_in_parts(texts, words, lambda trie, text: [trie.canonical(end) for _, end in trie.find(text)[:1]], "string")
    looked = df.withColumn("_text", F.col(column).cast("string")).join(found.select(F.col("text").alias("_text"), F.col("answer").alias("_form")), "_text", "left")
    return looked.withColumn(into, F.coalesce("_form", plain("_text"))).drop("_text", "_form")


def same_look(texts: DataFrame, ident: str, column: str, names: DataFrame, ref: str, name: str) -> DataFrame:
    """(id, ref): a text and a name that look the same but are not the same characters.

    The characters of the texts walk, as they are, through the automaton over a trie of the names. Names that may be sent
    are one trie in every task, which the texts pass without a shuffle; only rows found are shuffled, to drop repeats of
    an id. A larger vocabulary is cut into tries by first signs, where the different texts are walked and then joined back.
    Null texts and names, and those of which nothing is seen, match nothing; repeated rows count once; an empty table on
    either side gives no rows; other columns are not read.
    """
    kinds = dict(texts.dtypes)[ident], dict(names.dtypes)[ref]
    wanted = texts.select(F.col(ident).alias("id"), F.col(column).cast("string").alias("text")).where("text is not null and id is not null")
    listed = names.select(F.col(ref).alias("ref"), F.col(name).cast("string").alias("name")).where("name is not null and ref is not null").distinct()
    sent = _sent(texts.sparkSession, listed, "name")
    if sent is None:
        spelt = _walk_in_parts(wanted, listed.select("name").distinct(), lambda trie, text: [w for _, end in trie.find(text) for w in trie.spellings[end] if w != text], "string")
        pairs = spelt.join(listed, F.col("answer") == F.col("name")).select("text", "ref")
        return wanted.join(pairs, "text").select("id", "ref").distinct()
    as_arrow = [pa.int64() if k == "bigint" else pa.int32() if k == "int" else pa.string() if k == "string" else None for k in kinds]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, refs = Trie(n for _, n in sent.value), {}
        for r, n in sent.value:
            refs.setdefault(n, []).append(r)
        seen: dict[str, list] = {}

        def partners(text: str) -> list:
            if text not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[text] = [r for _, end in trie.find(text) for n in dict.fromkeys(trie.spellings[end]) if n != text for r in refs[n]]
            return seen[text]

        for batch in batches:
            coded = batch["text"].dictionary_encode()
            table = [partners(x) for x in coded.dictionary.to_pylist()]
            hits = pc.is_in(coded.indices, pa.array([i for i, x in enumerate(table) if x], pa.int32()))
            ids, which = batch["id"].filter(hits).to_pylist(), coded.indices.filter(hits).to_pylist()
            out = [(i, r) for i, w in zip(ids, which) for r in table[w]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], as_arrow[0]), pa.array([r for _, r in out], as_arrow[1])], ["id", "ref"])

    return wanted.mapInArrow(walk, f"id {kinds[0]}, ref {kinds[1]}").distinct()


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def look_sql(column: str) -> str:
    """SQL for what is seen of a column, from the tables above over the Basic Multilingual Plane: equal where texts look the same."""
    single, longer, gone = {}, {}, []
    for code in range(1, 0x10000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or (form := unicodedata.normalize("NFC", "".join(x for _, x in _EDGES[char]))) == unicodedata.normalize("NFC", char):
            continue
        if not form:
            gone.append(char)
        elif len(form) == 1:
            single[char] = form
        elif char in JOINED:
            longer[char] = form
    found = f"translate({column}, {_sql_text(''.join(gone))}, '')"
    found = f"translate(nfc_normalize({found}), {_sql_text(''.join(single))}, {_sql_text(''.join(single.values()))})"
    for char, form in longer.items():
        found = f"replace({found}, '{char}', '{form}')"
    # another pass composes letters whose mark or base was only now put in one script
    found = f"translate(nfc_normalize({found}), {_sql_text(''.join(single))}, {_sql_text(''.join(single.values()))})"
    return f"trim(nfc_normalize({found}), ' ')"
