"""The operators against plain Python on small, awkward tables."""

from __future__ import annotations

import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import block_search, merge_dropout, mixing, quality_rules, quotation, sanitise, simhash, suffix_dedup, token_counts, warc
from barloom.llm.components import connected_components
from tests.llm import brute

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion in the old stone tower near the river bank today. "


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows: list[tuple[int | None, str | None, str | None]] = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, PROSE * 6, "a"), (5, PROSE * 6, "b"), (5, PROSE * 6, "b"), (6, "one", "b"), (7, "One two", "c")]
    base = [rng.choice(words) for _ in range(700)]
    rows += [(10 + i, " ".join([*base[:350], f"x{i}", *base[350:]]) + ".", "c") for i in range(4)]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 300))) + ".\nA line here.\nA line here.", f"s{i % 5}") for i in range(30)]
    rows += [(60, "écrit à joe@x.example.com ou +1 (456) 555-2186, carte 4041894974608795 et 10.0.0.25\n" + PROSE, "a"), (61, "x" * 30_000, "a"), (62, " ".join(f"w{i}" for i in range(25_000)), "d"), (None, PROSE + "null id", "d"), (63, "Home | About | News | Contact | Shop | Help\n" + "Login | Cart | Terms | Jobs | Blog | Press\n" * 3, "e")]
    return rows


SCHEMA = "doc_id long, text string, source string, size string, target string, fp int, n_words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "s", "t", 1, "n") for r in rows], SCHEMA)


def key(r) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_quality_rules(spark):
    rows = texts()
    got = {(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.word_chars, r.n_symbols, r.base_failed, r.kept) for r in quality_rules.judge(frame(spark, rows)).collect()}
    for d, t, _ in rows:
        w = brute.WORD.findall(t or "")
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        row = (d, len(w), len(lines) - len(set(lines)), len(covered), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        mine = [g for g in got if g[:6] == row]
        assert len(mine) == 1, row
        assert mine[0][6] == failed
        assert not (failed and mine[0][7])
    kept = quality_rules.clean_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {g[0] for g in got if g[7]}
    assert 63 not in {g[0] for g in got if g[7]}
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_quality_removes_lines(spark):
    text = PROSE + "\nAll rights reserved.\na | b | c | d\n***\n\n" + PROSE
    row = quality_rules.judge(frame(spark, [(1, text, "a")])).first()
    assert row.clean_text == PROSE + "\n\n" + PROSE
    assert row.n_removed_lines == 3


def test_mixing(spark):
    rows = texts()
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(brute.WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            free.remove(s)
    target |= share
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.source_size == size[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    longest = defaultdict(int)
    for _, t, s in rows:
        longest[s] = max(longest[s], len(brute.WORD.findall(t or "")))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(frame(spark, rows)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixed_documents_follow_the_mix(spark):
    rows = [r for r in texts() if r[0] != 5]
    df = frame(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.size}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.where(F.length("text") > 0).groupBy("doc_id").count().collect()}
    assert {d: n for d, n in copies.items() if n} == {d: n for d, n in counts.items() if d in copies and copies[d]}


def test_sanitise(spark):
    rows = texts() + [(70, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.004 +12345678901 +1 2", "a"), (71, "4041-8949-7460-8795 4041 8949 7460 8796 " + "9" * 400, "a")]
    for r in sanitise.digest(frame(spark, rows)).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        counts, sha, _ = brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts.values()), r
        assert r.base_sha256 == sha
    assert sanitise.digest(frame(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in sanitise.sanitised(frame(spark, rows)).collect()}
    assert clean[60].startswith("écrit à [EMAIL] ou [PHONE], carte [CARD] et [IP]\n")
    assert clean[61] == "x" * 30_000


def test_disclosing_terms(spark):
    rows = [(i, f"word{i} alpha{i} Zorblatt beta{i} mail me at joe@x.example.com gamma{i} thanks", "a") for i in range(6)]
    rows += [(100 + i, f"nothing here number{i} mail the me at thanks", "a") for i in range(2000)] + [(5000, "Zorblatt lives in Rome", "b")]
    found = {r.doc_id: r.spans for r in sanitise.digest(frame(spark, rows)).where("doc_id in (0, 100, 5000)").collect()}
    assert found == {0: "term:13:21,email:39:56", 100: "", 5000: "term:0:8"}
    assert {r.text for r in sanitise.sanitised(frame(spark, rows)).where("doc_id = 5000").collect()} == {" lives in Rome"}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(spark, bucket):
    rows = [r for r in texts() if r[0] is not None]
    want = brute.simhash_components([(d, t) for d, t, _ in rows])
    got = simhash.components(frame(spark, rows), max_bucket=bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id)
        assert f"{r.fp & (2**64 - 1):016x}" == brute.simhash(text)
        assert r.component_id == want[r.doc_id]
    assert simhash.components(frame(spark, [])).count() == 0
    kept = simhash.deduplicated(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_dense_family(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {simhash.signed(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for _ in range(150)} | {simhash.signed(rng.getrandbits(64)) for _ in range(50)}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 8)
    assert _roots({(r.a, r.b) for r in edges.collect()}, prints) == _roots(want, prints)


def _roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 40)]
    nodes = {x for e in edges for x in e}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _roots(edges, nodes)
    assert got == {n: want[n] for n in got}
    assert {n for n in nodes if any(n in e and e[0] != e[1] for e in edges)} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(230)]
    rows += [(230 + i, rows[i][1], 0) for i in range(20)] + [(300, None, 0), (350, [0.0] * 8, 0), (301, [float("nan")] * 8, 0), (302, [1.0, None] + [0.5] * 6, 0), (400, [1.0, 2.0], 1), (401, [2.0, 4.1], 1), (500, [5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in block_search.search(df, spread=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    import numpy as np

    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in (i for i in vectors if i % 50 == 0):
        near = sorted(((-float(block_search.exact_cosine(vectors[q][None], v[None])[0]), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))[:5]
        assert [i for i, _ in got.get(q, [])] == [i for _, i in near]
        assert [s for _, s in got.get(q, [])] == [-s for s, _ in near]
    assert 300 not in got and 350 not in got and 500 not in got
    assert block_search.search(df.where("false"), spread=2).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = texts() + [(80, "a<|endoftext|>b <|endoftext|>", "a"), (81, "don't  stop  now \n\n x", "a")]
    for r in token_counts.digest(frame(spark, rows), path).collect():
        text = next((t for d, t, _ in rows if d == r.doc_id), None) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), r.doc_id
    assert token_counts.digest(frame(spark, []), path).count() == 0
    with open(path, "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(" \n\t'sdlr aeé漢0,.!<|endoftext|>\x85　") for _ in range(30))
        ends, counts = counter.prefixes(text)
        for place in range(len(text) + 1):
            n = len(library.encode(text[:place], add_special_tokens=False).ids)
            assert counter.count_at(text, ends, counts, place) == n == counter.count(text[:place])
        fit = token_counts.fit(ends, counts, 5)
        assert fit == 0 or counter.count(text[:fit]) <= 5 or "<" in text


def test_prefix_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    row = token_counts.prefix_tables(frame(spark, [(1, PROSE, "a")]), path).first()
    assert row.ends[-1] == len(PROSE) and row.counts[-1] == row.n_tokens == len(row.counts)


def test_merge_dropout(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain, varied = merge_dropout.DropoutEncoder(model, 0.0, 1), merge_dropout.DropoutEncoder(model, 0.3, 1)
    rng = random.Random(6)
    for i in range(400):
        text = "".join(rng.choice("  \n\tabcdeéß漢字😀theinging\x00▁" if i % 2 else " theandingerof") for _ in range(rng.randint(0, 60)))
        if "▁" not in text:
            assert plain.encode(text) == library.encode(text)
        assert varied.decode(varied.encode(text, i)) == text == plain.decode(plain.encode(text))
    assert len({tuple(varied.encode(PROSE, i)) for i in range(20)}) > 10
    rows = texts()
    got = merge_dropout.encoded(frame(spark, rows), path).collect()
    assert len(got) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in got)
    assert {(r.doc_id, tuple(r.ids)) for r in got} == {(r.doc_id, tuple(r.ids)) for r in merge_dropout.encoded(frame(spark, rows), path).collect()}
    back = {r.doc_id: r.text for r in merge_dropout.decoded(merge_dropout.encoded(frame(spark, rows), path), path).collect()}
    assert all(back[d] == (t or "") for d, t, _ in rows)
    assert merge_dropout.encoded(frame(spark, []), path).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(7)
    pages = [(1, "http://a", None), (2, "http://a", ""), (3, None, "<p>é</p>"), (4, "x", "<p>é</p>"), (5, "x", "".join(rng.choice("abc é\r\n") for _ in range(150_000))), (6, "y\r\n", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages += [(10 + i, "z", f"<html>{i // 2}</html>" * 900) for i in range(12)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    want = brute.warc_rows([(p, h) for p, _, h in pages])
    got = warc.digest(df).collect()
    assert sorted(r.page_id for r in got) == sorted(want)
    assert all(tuple(r)[1:] == want[r.page_id] for r in got)
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_roles(df), path, segment=5000, records_per_file=7)
    read = {r.page_id: bytes(r.payload) for r in warc.reassembled(warc.read_archives(spark, path)).where("record_type = 'response'").collect()}
    assert all(read[p] == (h or "").encode() for p, _, h in pages if want[p][2] == "response")
    # any reader of gzip files finds the records, each a member of its own
    import gzip

    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 1 and sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\nWARC-Type") for f in files) == warc.read_archives(spark, path).count()
    assert all(f.read_bytes().startswith(b"\x1f\x8b") and gzip.decompress(f.read_bytes()).endswith(b"\r\n\r\n") for f in files)
    other = tmp_path / "other"
    other.mkdir()
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    made = [warc.record("warcinfo", "urn:uuid:0", b"software: x", []), warc.record("response", "urn:uuid:1", block, [("WARC-Payload-Digest", "sha1:" + warc.digest_of(b"hello"))])]
    (other / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (other / "b.warc").write_bytes(b"".join(made))
    assert [bytes(r.payload) for r in warc.reassembled(warc.read_archives(spark, str(other))).collect()] == [b"hello"] * 2
    lost = warc.read_archives(spark, path).where("number is null or number <> 2")
    with pytest.raises(Exception, match="segment is missing"):
        warc.reassembled(lost).collect()
    assert warc.digest(df.where("false")).count() == 0


def test_warc_revisits_need_a_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x" * 50), (2, "b", "x" * 50)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_roles(pages), path)
    records = warc.read_archives(spark, path)
    assert sorted(tuple(r) for r in warc.described(records).select("page_id", "record_type", "refers_to", "payload_bytes").collect()) == [(1, "revisit", 2, 50), (2, "response", None, 50)]
    with pytest.raises(Exception, match="refers to no response"):
        warc.described(records.where("kind = 'revisit'")).collect()


def test_chunks():
    for size in (0, 1, 4095, 4096, 9000):
        assert warc.unchunked(warc.chunked(b"\r\n" * size)) == b"\r\n" * size
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_suffix_dedup(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(d, t) for d, t, _ in texts() if d != 5] + [(5, PROSE * 6)]
    rows += [(100 + i, f"start {i} " * rng.randint(1, 60) + passage[i * 10 : 900 - i * 7] + f" end {i} " * 50) for i in range(12)]
    rows += [(200, "ab" * 500), (201, passage[:399]), (202, passage[:400]), (203, "é" * 450), (204, "same" * 99 + "!" + "same" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeated_bytes(rows)
    got = suffix_dedup.digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id], r.doc_id
        assert r.kept_bytes == r.n_bytes - r.n_removed
    assert {r.doc_id: r.n_passage_words for r in got} == brute.repeated_words(rows)
    assert suffix_dedup.digest(df.where("false")).count() == 0


def test_word_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 64)
    rng = random.Random(18)
    words = lambda n: [rng.choice("abcde") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(n)]
    passage = words(90)
    rows = [(i, " ".join(words(30 * i)) + rng.choice([" ", "\n"]) + rng.choice([" ", "\t\n"]).join(passage[i : 40 + 5 * i]) + " " + " ".join(words(20))) for i in range(11)]
    twice = words(60)
    rows += [(50, " ".join(twice + words(3) + twice)), (51, rows[9][1]), (52, " ".join(passage[:51])), (53, None), (54, "x " * 200), (55, "x " * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.removed(df, passages=suffix_dedup.WORDS).collect()
    want = brute.repeated_words(rows)
    assert {r.doc_id: r.n_passage_units for r in got} == want and 0 < sum(n > 0 for n in want.values()) < len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {d: x[:3] for d, x in brute.repeated_bytes(rows).items()}


def test_difference_cover():
    for scheme, size in ((suffix_dedup.BYTES, 17), (suffix_dedup.WORDS, 5)):
        cover, modulus = suffix_dedup.difference_cover(scheme.q), scheme.modulus
        assert len(cover) == size and {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def test_quotation(spark):
    rows = [
        (1, 0, "user", "Hello there, this is the plan.\nSecond line!"), (1, 1, "a", "Fine by me."), (1, 2, "u", "> Hello there, this is  the plan.\n> second line\nI object."), (1, 3, "a", "why?"),
        (1, 4, "u", ">> Hello there, this is the plan.\n> I object.\n\nAgreed with you"), (1, 5, "x", "> Fine by me.\nOk"), (2, 0, "u", ">Agreed with you\nme too"), (2, 1, None, None), (1, None, "z", "zz"), (1, 3, "a", "why?"), (3, 0, "u", "> nobody said this\nstill"),
    ]
    got = quotation.reply_ordered(spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, position int, path string"))
    one = [(r.turn, r.reply_to_turn, r.own_text) for r in got.where("conv_id = 1").orderBy("position").collect()]
    assert one == [(None, None, "zz"), (0, None, rows[0][3]), (2, 0, "I object."), (4, 2, "Agreed with you"), (3, None, "why?"), (3, None, "why?"), (1, None, "Fine by me."), (5, 1, "Ok")]
    two = got.where("conv_id = 2").orderBy("position").collect()
    assert [(r.turn, r.reply_to_conv, r.reply_to_turn, r.own_text, r.position) for r in two] == [(0, 1, 4, "me too", 0), (1, None, None, "", 1)]
    three = got.where("conv_id = 3").first()
    assert (three.own_text, three.n_quotes, three.n_linked) == ("still", 1, 0)
    assert quotation.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def threads(seed: int, n: int) -> list[tuple[int, int, str, str]]:
    """Conversations whose messages quote parts of earlier ones, of other conversations and of quotes, at several levels."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows: list[tuple[int, int, str, str]] = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            sentence = lambda: " ".join(rng.choices(words, k=rng.randint(2, 5))).capitalize() + rng.choice(".!?")
            lines = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                pool = [r for r in rows if r[0] == conv] if rng.random() < 0.7 else rows
                if pool:
                    source = rng.choice(pool)[3].split("\n")
                    a = rng.randrange(len(source))
                    mark = rng.choice(["> ", ">", ">> ", "> > "])
                    lines += [mark + x for x in source[a : a + rng.randint(1, 3)]]
                    if rng.random() < 0.3:
                        lines.append(">" + rng.choice(["", " nobody " + sentence()]))
                lines += [sentence() for _ in range(rng.randint(0, 2))]
            for _ in range(rng.randint(0, 3)):
                lines += [sentence()] + [""] * rng.randint(0, 1)
            rows.append((conv, turn * rng.choice([1, 1, 3]) + 20 * turn, rng.choice("ua"), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("ranged", [4096, 25])
def test_quotation_of_threads(spark, monkeypatch, ranged):
    monkeypatch.setattr(quotation, "TURNS_PER_RANGE", ranged)
    rows = threads(ranged, 200)
    want = brute.conversations(rows)
    got = quotation.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        assert (r.own_text, r.n_quotes, r.n_linked, r.reply_to_conv, r.reply_to_turn, r.order_key, r.position) == want[r.conv_id, r.turn], (r.conv_id, r.turn)
    assert sum(w[2] for w in want.values()) > 100 and max(len(w[5]) for w in want.values()) > 3


def test_deep_reply_chains(spark):
    n = 40
    rows = [(1, 0, "u", "message number zero")] + [(1, t, "u", f"> message number {'zero' if t == 1 else t - 1}\nmessage number {t}") for t in range(1, n)]
    got = quotation.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [r.turn for r in got] == list(range(n))
    assert got[-1].order_key == list(range(n))


def test_cosines_do_not_overflow(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [3.0, 4.0])]
    got = {(r.query_id, r.vec_id): r.score for r in block_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == pytest.approx(0.5**0.5) and got[0, 2] == pytest.approx(1.0) and got[0, 3] == pytest.approx(7 / 50**0.5)


def test_long_quotes(spark):
    lines = [f"line number {i} of a long message" for i in range(20_000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join("> " + x for x in lines) + "\nanswer")]
    got = quotation.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [(r.turn, r.reply_to_turn, r.n_quotes, r.n_linked) for r in got] == [(0, None, 0, 0), (1, 0, 1, 1)] and got[1].own_text == "answer"


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __kept long, __kept_tid string, __judged string, tid long, root string, spans string, row string, src string, copies int"


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en", s, len(t or ""), 1, "a", "b", 2, "c", "d", "e", "f", 3) for d, t, s in texts()]
    df = spark.createDataFrame(rows, CLASHING)
    df.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    df.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").collect()
        assert out and all(tuple(r)[5:] == rows[0][5:] for r in out), name
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert len(suffix_dedup.digest(docs).collect()) == len(rows) == len(simhash.digest(docs).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = texts()
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert out and all(r.lossless for r in out)
    assert {r.doc_id for r in out} <= kept


def test_search_in_parts_of_queries(spark, monkeypatch):
    """Queries in several blocks and parts against several blocks of candidates, with many equal vectors; Spark joins no blocks, which it would hold on the heap."""
    import numpy as np

    for name, value in (("QUERY_BYTES", 40 * 48), ("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 32)):
        monkeypatch.setattr(block_search, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (400, 12)).astype(np.float32)
    vectors[200:230] = vectors[:30]
    vectors[(vectors == 0).all(axis=1)] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, Embedding array<float>")
    found = block_search.search(df, every=4, spread=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wide = vectors.astype(np.float64)
    for q in range(0, 400, 4):
        score = block_search.exact_cosine(np.repeat(wide[q][None], 400, axis=0), wide)
        order = [i for i in np.lexsort((np.arange(400), -score)).tolist() if i != q][:5]
        assert got[q] == [(i, score[i]) for i in order]
    assert len(got) == 100
