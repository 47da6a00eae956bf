"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import merge_dropout, quotation, sanitise, simhash, token_counts


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def grouped(texts: list[str]) -> int:
    """Number of connected components of texts at Jaccard 0.8."""
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for k in range(i):
            if root[k] != root[i] and jaccard(a, texts[k]) >= 0.8:
                root = [root[k] if r == root[i] else r for r in root]
    return len(set(root))


def test_near_copies_of_short_texts_are_one(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = "Changed"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.doc_id for r in simhash.deduplicated(df).collect()]
    assert len(kept) == grouped(texts) < len(texts)
    assert simhash.deduplicated(df.where("false")).count() == 0


def test_deduplication_keeps_a_row_of_each_group(spark):
    prose = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(6)]
    # null keys of three different texts, one of them a copy of document 1; two texts under key 2; a removed copy that shares its key with another text
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (1, prose[2]), (None, prose[2]), (2, prose[3]), (2, prose[4]), (3, prose[3]), (3, prose[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.deduplicated(df).collect()), key=str)
    assert kept == sorted([(0, prose[0]), (0, prose[1]), (1, prose[2]), (2, prose[3]), (2, prose[4]), (3, prose[5])], key=str)


def by_agendas(encoder, text: str, stream: int) -> list[int]:
    """Every word segmented on its own by the heap."""
    words, keys = encoder.words_of(text, stream)
    return [i for w, k in zip(words, keys.tolist(), strict=True) for i in (encoder.literal if w is None else encoder.spelled(encoder.merged(w, k)))]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.9])
def test_trees_give_what_the_agendas_give(rate):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        encoder = merge_dropout.DropoutEncoder(f.read(), rate, 5)
    rng = random.Random(11)
    letters = "  eeetaoinsrh\n漢😀ß▁"
    texts = ["", " ", "▁", " ▁ ▁▁a", "y" * 300 + " " + "international" * 9, *("".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(150))]
    for together in (texts, texts[::-1], texts):
        streams = [len(t) for t in together]
        assert encoder.encode_batch(together, streams) == [by_agendas(encoder, t, s) for t, s in zip(together, streams, strict=True)]


def test_dropout_is_drawn_at_every_place(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        encoder = merge_dropout.DropoutEncoder(f.read(), 0.1, 1)
    text = " ".join(["international"] * 500)
    spellings, word = set(), []
    for i in [*encoder.encode(text, 3), None]:
        if word and (i is None or encoder.raw[i].startswith(b" ")):
            spellings.add(tuple(word))
            word = []
        word.append(i)
    assert len(spellings) > 10
    # what is kept of earlier texts never changes a result
    fresh = merge_dropout.DropoutEncoder.__new__(merge_dropout.DropoutEncoder)
    fresh.__dict__ |= encoder.__dict__ | {"tree": merge_dropout.Tree(encoder.literal)}
    other = " ".join(random.Random(2).choices(["the", "international", "x" * 60, "ing漢"], k=200))
    assert encoder.encode(other, 9) == fresh.encode(other, 9) == by_agendas(fresh, other, 9)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text + " international")], "doc_id long, text string")
    assert len({tuple(r.ids[:500]) for r in merge_dropout.encoded(df, path, copies=True).collect()}) == 4
    assert len({tuple(r.ids) for r in merge_dropout.encoded(df.where("doc_id = 1"), path).collect()}) == 1


def test_fit_ends_inside_pre_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    rng = random.Random(4)
    texts = ["漢字仮名交" * 12, "Donaudampfschifffahrtsgesellschaft" * 4, "x" + " " * 90 + "y", "<|endoftext|>" * 5, "we'll don't 'stop  'red\n\n  x", ""]
    texts += ["".join(rng.choice([" ", "\n", "\t", "'", "ll", "s", "ab", "é", "漢", "0", "<|endoftext|>", "!", "\x85"]) for _ in range(25)) for _ in range(60)]
    for text in texts:
        sizes = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        ends, counts = counter.prefixes(text)
        for budget in range(0, sizes[-1] + 2):
            assert counter.fit(text, ends, counts, budget) == max(i for i, n in enumerate(sizes) if n <= budget), (text, budget)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = token_counts.prefix_tables(df, path, tables=False, limit=5).collect()
    assert 0 < next(r.n_fit for r in rows if r.doc_id == 0) < 60
    assert len(counter.tables["漢字仮名交"]) == 16


def disclosing_rows() -> list[tuple[int, str]]:
    rows = [(i, f"word{i} alpha{i} Zorblatt beta{i} mail me at joe@x.example.com gamma{i} thanks") for i in range(6)]
    return rows + [(100 + i, f"nothing here number{i} mail the me at thanks") for i in range(2000)] + [(5000, "Zorblatt lives in Rome")]


def test_copies_do_not_hide_disclosing_terms(spark):
    rows = disclosing_rows()
    rows += [(6000 + i, rows[0][1]) for i in range(20)] + [(6100 + i, f"{rows[1][1]} and some other words follow here in copy {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in sanitise.digest(df).where("doc_id in (0, 100, 5000, 6003)").collect()}
    assert found == {0: "term:13:21,email:39:56", 100: "", 5000: "term:0:8", 6003: "term:13:21,email:39:56"}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_quotes_of_parts_of_a_message_are_linked(spark):
    rows = [
        (1, 0, "u", "First paragraph here.\n\nSecond one follows.\n\nThird one ends."), (1, 1, "a", "line one is this\nline two is that\nline three too\nline four now\nline five last"), (1, 2, "u", "Not quoted by anyone."),
        (1, 3, "a", "> First paragraph here.\n>\n> Second one follows.\nI see."), (1, 4, "u", "> line two is that\n> line three too\nYes."),
        (1, 5, "a", "> Not quoted by anyone.\nmy answer has\ntwo whole lines\n> Third one ends.\nand my end"), (1, 6, "u", "> my answer has\n> two whole lines\nRight."), (1, 7, "u", "> and my end\n> words that nobody wrote\nRight."), (2, 0, "u", "> line four now\n> line five last\nElsewhere."),
    ]
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to_conv, r.reply_to_turn) for r in quotation.reply_ordered(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert [got[1, t] for t in (3, 4, 6, 7)] == [(1, 1, 1, 0), (1, 1, 1, 1), (1, 1, 1, 5), (1, 1, 1, 5)]
    assert got[1, 5][:2] == (2, 2) and got[2, 0] == (1, 1, 1, 1)


def test_quotes_fall_back_to_the_first_other_conversation(spark):
    rows = [(1, 0, "u", "> a passage known elsewhere\nAgreed."), (1, 1, "a", "a passage known elsewhere"), (4, 2, "u", "a passage known elsewhere"), (3, 5, "u", "A passage known elsewhere!")]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to_conv, r.reply_to_turn) for r in quotation.reply_ordered(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert got[1, 0] == (1, 3, 5)


def test_windows_reach_five_words_whatever_their_length(spark):
    left = ["zero", "Alpha", "beta" * 30, "gamma", "delta", "epsilon"]
    right = ["one1", "two2", "three" * 60, "four", "five", "six6"]
    text = " ".join(left[:3]) + " " * 300 + " <b> ".join(left[3:]) + " a@b.cd " + ("of" + "\n" * 300).join(f" {w} " for w in right)
    start = text.index("a@b.cd")
    df = spark.createDataFrame([(text, start, start + 6), ("a@b.cd", 0, 6), ("one two a@b.cd", 8, 14)], "text string, start long, end long")
    got = [r[0] for r in df.select(sanitise.window_terms(F.col("text"), F.struct("start", "end"), 5)).collect()]
    assert got == [sorted(w.lower() for w in left[1:] + right[:5]), [], ["one", "two"]]
