"""Operators against brute force, exact round trips and held-out accuracy, with awkward rows in every table."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import chat, components, fingerprints, minhash, packing, quality_classifier, quality_rules, registry, sentence_pieces, substrings, toxicity, warc
from lexspark.llm.common import read

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _w string"


def texts(seed=3):
    """Prose, copies, near copies, shared passages, repeated lines, empty, null, tiny and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    base, passage = prose(120), prose(60)
    out = [" ".join(prose(rng.randint(1, 300))) for _ in range(20)]
    for edits in (1, 1, 2, 2, 3, 3, 4, 6, 8):
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    out += [" ".join(base), " ".join(base).upper(), " ".join(base)]
    out += [" ".join(prose(50) + passage + prose(30)) for _ in range(4)]
    out += [
        "x " * 100, "a b c\n" * 40, "", None, "   \n\t", "One two", "one TWO", "é# 日本 | $ <b>", "a <|endoftext|> b<|endoftext|>",
        "word " + "z" * 5000, " ".join(prose(3000)), "same\n" * 3 + " ".join(prose(40))
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", None) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[3]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_as_sql(spark, docs, got, sql):
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = c.sql(sql)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    wanted = sorted(map(
        repr, zip(*[[r[want.columns.index(k)] for r in rows] for rows in [want.fetchall()] for k in order], strict=True)
    ))
    assert sorted(repr(tuple(r[k] for k in order)) for r in got.collect()) == wanted


def test_quality_rules(spark, docs, nothing):
    same_as_sql(spark, docs, quality_rules.quality_rules(docs), quality_rules.ORACLE_SQL)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = collections.Counter(r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == good
    assert quality_rules.quality_rules(nothing).count() == quality_rules.keep_good(nothing).count() == 0


def test_sentence_pieces(spark, docs, nothing):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = dict(pairs(docs))
    for row in sentence_pieces.encode(docs, path, dropout=0.0).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == model.encode(known[row.doc_id])
    dropped = {seed: {r.doc_id: bytes(r.ids) for r in sentence_pieces.encode(docs, path, 0.3, seed).collect()} for seed in (1, 1, 2)}
    again = {r.doc_id: bytes(r.ids) for r in sentence_pieces.encode(docs.repartition(5), path, 0.3, 1).collect()}
    assert dropped[1] == again and dropped[1] != dropped[2]
    back = sentence_pieces.decode(sentence_pieces.encode(docs, path, 0.3, 2), path).collect()
    assert len(back) == docs.count() and all(r.text == known[r.doc_id] for r in back)
    # all of a word's candidates skipped: single characters
    ids = next(r.ids for r in sentence_pieces.encode(docs.where("text = 'One two'"), path, 1.0).collect())
    assert [model.id_to_piece(i) for i in np.frombuffer(ids, "<u4").tolist()] == list("▁One▁two")
    assert sentence_pieces.encode(nothing, path).count() == 0


def test_long_stretches_merge_alike():
    import public_tokenizers

    model = sentence_pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.2, 5)
    rng = np.random.default_rng(1)
    for _ in range(50):
        symbols = model.of_char[np.array([ord(c) for c in "".join(rng.choice(list("the anding"), 30)).replace(" ", "e")])]
        salt = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        flat, lengths = model.segments(symbols.copy(), np.array([0, len(symbols)]), salt)
        assert flat.tolist() == model.segment(symbols, salt[0]) and lengths.tolist() == [len(flat)]


def test_each_occurrence_draws_its_own_skips():
    """A word seen often has many segmentations, and each text's ids are those of an agenda of its own for every stretch."""
    import public_tokenizers

    model = sentence_pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.3, 5)
    held = ["international"] * 300 + [" international cats", "the thing  and\nthe thing", "", "é# 日本 " + "anding" * 20] * 20
    keys = sentence_pieces.mix(np.arange(len(held)).astype(np.uint64), 1)
    got = [ids for c in sentence_pieces.chunks(sentence_pieces.pa.array(held)) for ids in model.encode(c, keys[c.lo : c.hi])]
    assert len({ids.tobytes() for ids in got[:300]}) > 30
    for t, key, ids in zip(held, keys, got, strict=True):
        want = []
        stretches = re.findall(r"[\x00-\x1f]| +[^ \x00-\x1f]*|[^ \x00-\x1f]+", " " + t) if t else []
        for place, stretch in enumerate(stretches):
            salt = sentence_pieces.mix(np.array([key]) + np.uint64(place), 5)[0]
            symbols = model.segment(model.of_char[[ord(x) for x in stretch]], salt)
            want += model.spelled(np.array(symbols), np.array([len(symbols)]))[0].tolist()
        assert ids.tolist() == want
        assert model.decode(ids) == t


def test_warc(spark, tmp_path):
    rows = [
        (1, "http://a\r\nX: y", "<p>é</p>"), (5, "u", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "u", None), (9, "u", ""),
        (7, "u", "other"), (7, "u", "other"), (10, "http://a/%0D", "lone"), (11, "http://a/\r", "lo"),
        (12, "http://a/%250D%", "l"), (13, "\n%0a%", "long " * 50_000)
    ]
    rows += [(100 + i, f"v{i}", "hot") for i in range(700)]
    table = spark.createDataFrame(
        rows, "page_id long, url string, html string"
    ).withColumn("address", F.lit(1)).withColumn("n", F.lit("x"))
    warc.write_archive(table, f"file://{tmp_path}/w")
    got = warc.read_archive(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) and spark.read.parquet(f"file://{tmp_path}/w/payloads").where("shares = 3").count() == 1
    assert sorted(((r.page_id, r.url is None, r.url or "") for r in got)) == sorted((p, u is None, u or "") for p, u, _ in rows)
    keeper = {"<p>é</p>": 5, "": 9, "other": 7, "lone": 10, "lo": 11, "l": 12, "long " * 50_000: 13, "hot": 799}
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r.page_id)
        body = html.encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = keeper[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", keeper[html]))
        assert bytes(r.record).endswith((body if first else b"") + b"\r\n\r\n") and bytes(r.payload) == body
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == len(keeper)
    warc.write_archive(table.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def record_by_hand(page, url, body, digest, refers_to):
    """A record's bytes in plain Python."""
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = body if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(block)}"]
    return "".join(f"{x}\r\n" for x in [*lines, ""]).encode() + block + b"\r\n\r\n"


def test_warc_query(spark):
    rows = read(spark, DATA, "pages").collect()
    pages = {r.page_id: (r.html or "").encode() for r in rows}
    last = {b: max(p for p, x in pages.items() if x == b) for b in pages.values()}
    got = registry.QUERIES["op3_warc"](spark, DATA)
    assert dict(got.dtypes) == {
        "page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint",
        "record_sha256": "string"
    }
    want = set()
    for r in rows:
        body = pages[r.page_id]
        digest, other = base64.b32encode(hashlib.sha1(body).digest()).decode(), None if last[body] == r.page_id else last[body]
        record = record_by_hand(r.page_id, r.url, body, digest, other)
        want.add((r.page_id, len(body), digest, "response" if other is None else "revisit", other, hashlib.sha256(record).hexdigest()))
    assert {tuple(r) for r in got.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_sha256"
    ).collect()} == want and got.count() == len(pages)


def test_packing(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in pairs(docs):
        want[(d, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [0]))] += 1
    pieces = packing.pack(docs, path, window=64).collect()
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    partial = 0
    for held in windows.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        size = sum(p.length for p in held)
        assert size <= 64
        partial += size < 64
    assert partial <= docs.rdd.getNumPartitions()
    got = collections.Counter()
    by = collections.defaultdict(list)
    for p in pieces:
        by[(p.doc_id, p.doc_tokens)].append(p)
    for (d, n), held in by.items():
        held.sort(key=lambda p: p.start)
        copies = sum(p.length for p in held) // n
        ids = {p.start: np.frombuffer(p.ids, "<u4").tolist() for p in held}
        if copies == 1:
            got[(d, tuple(x for s in sorted(ids) for x in ids[s]))] += 1
    assert all(want[k] == v for k, v in got.items()) and sum(p.length for p in pieces) == sum(len(k[1]) * v for k, v in want.items())
    assert packing.pack(nothing, path).count() == 0


def test_packing_query(spark, tmp_path):
    """The ids of every piece of the registered query, over texts that name the control string, too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(texts(9))] + [(900, "<|endoftext|>"), (901, "x <|endoftext|><|endoftext|>\n日本")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    got = registry.QUERIES["op4_packing"](spark, f"file://{tmp_path}")
    assert dict(got.dtypes) == dict.fromkeys(
        ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint"
    )
    by = collections.defaultdict(list)
    for p in got.collect():
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.offset + p.length <= 1024
        by[p.doc_id].append((p.start, p.length))
    assert {d: sum(n for _, n in held) for d, held in by.items()} == {d: len(ids) for d, ids in want.items()}
    assert all(sorted(held) == sorted(held) and sum(n for s, n in sorted(held)[:i]) == sorted(held)[i][0] for held in by.values() for i in range(len(held)))


def said_by(rows):
    """What each conversation of (conv, turn, role, text) says, by plain sorting."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by["null" if c is None else f"={c}"].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, held in by.items():
        held.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in held)
        loss = "".join(x for _, r, x in held if r == "assistant")
        out[c] = (len(held), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [
        (1, 0, "user", "hi\\ ### </turn>"), (1, 1, "assistant", "a\nb"), (2, 0, "user", "hi\\ ### </turn>"),
        (2, 1, "assistant", "c"), (2, 2, "user", None), (3, 0, "sys\ntem%", ""), (3, 1, "assistant", ""),
        (None, 0, "user", "hi\\ ### </turn>"), (4, None, "user", "x"), (4, 1, "assistant", "\\</turn>### é😀\\"),
        (4, 1, "assistant", "\\</turn>### é😀\\")
    ]
    rows += [
        (5, 0, "user", "long é </turn>\n \\" * 2000), (5, 1, "assistant", "日本 <|endoftext|>" * 1500),
        (6, 0, "user", "long é </turn>\n \\" * 2000), (6, 1, "assistant", "</turn>\n"), (6, 2, "assistant", "\\</turn>\n\\")
    ]
    rows += [(7, i // 2, ("user", "assistant")[i % 2], f"t{i}") for i in range(30)]
    table = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"
    ).withColumn("node", F.lit(1)).withColumn("conv", F.lit("x"))
    tree, turns = chat.prefix_tree(table, path)
    got = {r.conv: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(tree, turns, path).collect()}
    assert got == said_by(rows)
    nodes = tree.orderBy("stream_start").collect()
    assert len(nodes) == len(rows) - 3  # the shared first turns are there once
    at = 0
    for n in nodes:
        assert n.stream_start == at and n.position == sum(s.to - s["from"] for s in n.attends) and n.tokens == len(n.ids) // 4
        at += n.tokens
    ids = np.concatenate([np.frombuffer(n.ids, "<u4") for n in nodes])
    blocks = chat.stream(tree).orderBy("block").collect()
    assert np.concatenate([np.frombuffer(b.ids, "<u4") for b in blocks]).tolist() == ids.tolist() and all(len(b.mask) == len(b.ids) // 4 == 1024 for b in blocks[:-1])
    for n in nodes:  # what a node may attend to is the tokens of its ancestors
        seen = np.concatenate([np.zeros(0, np.uint32), *[ids[s["from"] : s.to] for s in n.attends]])
        path_of = [m for m in nodes if any(s["from"] <= m.stream_start < s.to for s in n.attends)]
        assert len(path_of) == n.k and sorted(m.k for m in path_of) == list(range(n.k)) and sum(m.tokens for m in path_of) == len(seen)
    nothing = chat.prefix_tree(table.limit(0), path)
    assert nothing[0].count() == 0 and chat.read_back(*nothing, path).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, DATA, "conversations").collect()]
    said = "\\### Assistant: </turn> ok"
    want = said_by(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = registry.QUERIES["op5_chat_prefix_tree"](spark, DATA)
    assert dict(got.dtypes) == {
        "conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
        "formatted_chars": "bigint"
    }
    assert {f"={r.conv_id}": (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == want


def test_fingerprints(spark, docs, nothing):
    got = fingerprints.fingerprints(docs).collect()
    rows = sorted(pairs(docs), reverse=True)
    want = collections.Counter()
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    of = {r.doc_id: (r.fp_hi, r.fp_lo) for r in got}
    for i, (d, _) in enumerate(rows):
        r = next(x for x in got if x.doc_id == d)
        if i + 1 == len(rows) or rows[i + 1][0] != d:
            assert (r.next_hi, r.next_lo) in (of[rows[(i + 1) % len(rows)][0]], of[d])
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t].add(of[d])
    assert all(len(x) == 1 for x in same.values()) and of[next(d for d, t in rows if t == "")] == (0, 0)
    assert fingerprints.fingerprints(nothing).count() == 0
    one = fingerprints.fingerprints(docs.where("doc_id = 7")).first()
    assert (one.fp_hi, one.fp_lo) == (one.next_hi, one.next_lo)


def voted(text):
    """A fingerprint by plain counting."""
    import xxhash

    spark_hash = lambda *parts: __import__("functools").reduce(
        lambda seed, p: xxhash.xxh64_intdigest(p, seed=seed), parts, 42
    )
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes = [0] * 128
    for i, w in enumerate(words):
        after = words[i + 1 : i + 2]
        weight = min(16, len(w) + sum(map(len, after)))
        term = (spark_hash(w.encode(), *[x.encode() for x in after]) & ~15) | (weight - 1)
        raw = term.to_bytes(8, "little")
        bits = spark_hash(raw) << 64 | spark_hash(raw, (1).to_bytes(4, "little"))
        for b in range(128):
            votes[b] += weight if bits >> b & 1 else -weight
    return sum(1 << b for b in range(128) if votes[b] > 0)


def test_fingerprint_query(spark, tmp_path):
    rows = [
        (i * 25, t) for i, t in enumerate(texts(5))
    ] + [(
        2000 + i, "one two three four five six seven eight nine ten " * 6 + f"x{i}"
    ) for i in range(30)] + [(5000 + i, "one two three four five six seven eight nine ten " * 6 + "y") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = registry.QUERIES["op6_fingerprints"](spark, f"file://{tmp_path}")
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
        "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "n_near": "bigint"
    }
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    known = [voted(t) for _, t in order]
    want = {}
    for i, (d, t) in enumerate(order):
        half, after = len(t) // 2, (i + 1) % len(order)
        edited = voted(t[: len(t) - half] + order[after][1][:half])
        alike = lambda x, y: 1 - bin(x ^ y).count("1") / 128
        near = sum(0 < bin(known[i] ^ x).count("1") <= 6 for x in set(known)) if d % 100 == 0 else None
        want[d] = (f"{known[i]:032x}", f"{edited:032x}", alike(known[i], edited), alike(known[i], known[after]), near)
    assert {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in got.collect()} == want
    assert max(x[4] or 0 for x in want.values()) > 0


def test_near_fingerprints_are_all_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(30)]
    marks = list(base)
    for b in base:
        for flips in range(1, 9):
            x = b
            for i in rng.sample(range(128), flips):
                x ^= 1 << i
            marks.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame(
        [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in marks] + [(None, 1)], "fp_hi long, fp_lo long"
    )
    asked = table.limit(100)
    queries = {(r.fp_hi, r.fp_lo) for r in asked.collect() if r.fp_hi is not None}
    bits = lambda p: ((p[0] & (1 << 64) - 1) << 64) | (p[1] & (1 << 64) - 1)
    every = {(r.fp_hi, r.fp_lo) for r in table.collect() if r.fp_hi is not None}
    want = sorted((q, x, n) for q in queries for x in every if 0 < (n := bin(bits(q) ^ bits(x)).count("1")) <= 6)
    got = sorted(((r.q_hi, r.q_lo), (r.fp_hi, r.fp_lo), r.distance) for r in fingerprints.near(
        spark.createDataFrame(list(queries), "fp_hi long, fp_lo long"), table
    ).collect())
    assert got == want


def brute_groups(rows, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    least = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {d: (len(s), least[d]) for d, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, nothing, percent):
    want = brute_groups(pairs(docs), percent)
    got = minhash.near_duplicates(docs, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = minhash.one_of_each(docs, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({m for _, m in want.values()})
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_component_stays(spark):
    t, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [
        (3, t), (5, t + " x"), (5, other), (5, other), (7, other + " y"), (8, ""), (8, None), (8, " "), (None, "lone one"),
        (None, "lone one"), (9, "p q"), (9, "p q r")
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))
    got = minhash.one_of_each(table)
    assert got.columns == table.columns
    texts = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").strip()) for r in got.collect()))
    assert texts == sorted([
        (False, 3, t), (False, 5, other), (False, 8, ""), (True, 0, "lone one"), (False, 9, "p q"), (False, 9, "p q r")
    ])


def test_hot_group_of_near_copies(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(60)]
    base = rng.choices(vocabulary, k=80)
    rows = []
    for i in range(120):
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((i, " ".join(near)))
    rng.shuffle(rows)
    want = brute_groups(rows, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_hot_text_and_hot_band(spark):
    """A third of all rows share one text, and very many different texts share their bands: rows of neither are shuffled by it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(3 * i, " ".join(base)) for i in range(300)]
    for i in range(150):  # one edit each: all are near the hot text
        near = list(base)
        near[rng.randrange(400)] = f"e{i}"
        rows.append((3 * i + 1, " ".join(near)))
    for i in range(450):
        rows.append((3 * i + 2, " ".join(f"{i}v{j}" for j in range(8))))
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 85)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert len(found) == len(rows)
    assert found == {d: (396 if len(t.split()) == 400 else 4, 0 if len(t.split()) == 400 else d) for d, t in rows}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 30)) for _ in range(50)] + [
        (7, 7), (None, 3), (41, 200), (200, 201)
    ]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[40] == got[0] == 0 and got[201] == 41 and all(got[x] == 100 for x in got if 100 <= x <= 130)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings(spark, docs, nothing):
    same_as_sql(
        spark, docs, substrings.cut_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256"), substrings.ORACLE_SQL
    )
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert substrings.cut_repeats(nothing).count() == 0


def test_what_stands_between_words_stays(spark):
    passage = " \n".join(f"p{i}" for i in range(40))
    code = "def f(x):\n\tif x:\n        return  1\n\n\n"
    rows = [
        (1, code), (2, "\n a\n\n  " + passage + "\n\n\tb  c\r\n"), (3, passage + "  end"), (4, "\n\n"), (5, " q\n" * 40),
        (6, " q\n" * 40), (7, "  é\n" + passage.replace(" \n", "\t"))
    ]
    got = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: code, 2: "\n a\n\n  \n\n\tb  c\r\n", 3: "  end", 4: "\n\n", 5: "", 6: "", 7: "  é\n"}


def revealed(h):
    """(name, start) of every window of one text that some name would reveal."""
    symbols = substrings.Symbols(h, np.ones(len(h), np.int64), np.ones(len(h), bool), np.array([0, len(h)]))
    out = set()
    for r in range(len(substrings.RUNS)):
        symbols, long, repeats = substrings.name_runs(symbols, r)
        which, top, span = substrings.run_places(symbols.at[long], symbols.size[long], substrings.RUNS[r] + 1)
        out |= {
            (int(repeats[i]), r, x) for i, t,
            n in zip(which, top.tolist(), span.tolist(), strict=True) for x in range(t - n, t + 1)
        }
        symbols = substrings.name_pairs(symbols, r)
    assert symbols.size.sum() == len(h)
    for n, top, span, _ in zip(*substrings.phrases(symbols), strict=True):
        out |= {(int(n), 9, x) for x in range(top - span, top + 1)}
    return out


def test_equal_windows_are_revealed_alike():
    rng = np.random.default_rng(4)
    few = lambda n: np.repeat(rng.integers(0, 40, n), rng.integers(1, 9, n))[:n]
    kinds = [
        lambda n: rng.integers(0, 50, n), lambda n: rng.integers(0, 3, n), lambda n: rng.integers(0, 2, n), few,
        lambda n: np.arange(n) // 1 % 2, lambda n: np.zeros(n, np.int64), lambda n: np.arange(n) % 5
    ]
    for trial in range(600):
        small = kinds[trial % len(kinds)](35)
        found = []
        for _ in range(2):
            before, after = (kinds[rng.integers(len(kinds))](rng.integers(0, 60)) for _ in range(2))
            h = substrings.mix(np.concatenate([before, small, after]).astype(np.uint64))
            found.append({(n, r) for n, r, x in revealed(h) if x == len(before)})
        assert found[0] & found[1]


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_texts_that_differ_in_many_places_are_told_apart(spark):
    """Sums of powers modulo 2**64 are equal for such pairs, whatever the base."""
    own = [f"w{i}" for i in range(2048)]
    lines = [" ".join(x for pair in zip(
        own, thue_morse(2048, *ab), strict=True
    ) for x in pair) for ab in (("a", "b"), ("b", "a"))]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.n_removed for r in substrings.cut_repeats(table).collect()] == [0, 0]
    words = ["".join(thue_morse(1024, *ab)) for ab in (("a", "b"), ("b", "a"))]
    table = spark.createDataFrame(
        [(i, f"one two three {w} five six seven") for i, w in enumerate(words)], "doc_id long, text string"
    )
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(table).collect()} == {(0, 0), (1, 1)}


def held_out(spark, name, label, folds, held):
    d = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r[label] for r in read(spark, d, "labels").collect() if r[label] is not None}
    rows = registry.QUERIES[name](spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 for r in rows)
    return [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def area(rows):
    good, bad = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_classifier(spark, docs, nothing):
    assert area(held_out(spark, "op7_quality_classifier", "quality", 4, 2)) > 0.95
    labels = read(spark, DATA, "labels")
    model = quality_classifier.train(read(spark, DATA, "documents"), labels)
    assert quality_classifier.score(docs, model).count() == docs.count() and quality_classifier.score(nothing, model).count() == 0
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    assert quality_classifier.train(nothing, labels.limit(0)).scores(
        np.zeros((1, quality_classifier.FEATURES)), np.array([0, 1])
    ) is not None


def test_toxicity(spark, docs, nothing):
    rows = held_out(spark, "op10_toxicity", "toxic", 5, 0)
    assert area(rows) > 0.75 and sum(p for _, p, y in rows if not y) <= 0.02 * len(rows)
    machine = toxicity.train(nothing, read(spark, DATA, "labels").limit(0))
    assert toxicity.score(docs, machine).count() == docs.count() and toxicity.score(nothing, machine).count() == 0


def test_pairs_of_terms_count():
    """Two terms are harmless alone and toxic together: no sum of single weights can tell."""
    rng = np.random.default_rng(0)
    bags = [[i for i in (1, 2) if rng.random() < 0.5] + rng.integers(10, 40, 5).tolist() for _ in range(800)]
    y = np.array([float({1, 2} <= set(b)) for b in bags])
    bags = [np.unique(b) for b in bags]
    machine = toxicity.fit(np.concatenate(bags), np.append(0, np.cumsum([len(b) for b in bags])), y)
    score = lambda b: machine.scores(np.array(b), np.array([0, len(b)]))[0]
    assert score([1, 2]) > 0.5 > max(score([1, 11]), score([2, 12]), score([15]))


def test_pairs_without_a_lean_count():
    """Neither term tells anything alone: half of the texts are toxic with it, and without it."""
    rng = np.random.default_rng(1)
    bags = [np.unique([i for i in (1, 2) if rng.random() < 0.5] + rng.integers(10, 3000, 5).tolist()) for _ in range(1600)]
    y = np.array([float((1 in b) == (2 in b)) for b in bags])
    machine = toxicity.fit(np.concatenate(bags), np.append(0, np.cumsum([len(b) for b in bags])), y)
    assert machine.buckets.tolist() == sorted({int(x) for b in bags for x in b})  # none is left out
    score = lambda b: machine.scores(np.array(b), np.array([0, len(b)]))[0]
    assert min(score([1, 2]), score([])) > 0.5 > max(score([1]), score([2]))
    assert np.allclose(
        machine.scores(np.array([1, 2, 1]), np.array([0, 0, 2, 3, 3])), [score([]), score([1, 2]), score([1]), score([])]
    )


def test_attention_by_plain_loops():
    """Scores against a forward pass written out, passage by passage."""
    rng = np.random.default_rng(3)
    x, first = rng.normal(size=(30, 12)), np.array([0, 4, 5, 17, 30])
    model = quality_classifier.fit(x, first, np.array([1.0, 0, 1, 0]))
    w, sig = model.w, lambda z: 1 / (1 + np.exp(-z))
    for i, got in enumerate(model.scores(x, first)):
        hs, es = [], []
        for row in x[first[i] : first[i + 1]]:
            h = np.tanh(((row - model.mean) / model.scale) @ w["We"] + w["be"])
            hs.append(h)
            es.append(float(np.sum(w["a"] * np.tanh(h @ w["V"]) * sig(h @ w["U"]))))
        share = np.exp(es) / np.sum(np.exp(es))
        z = sum(s * h for s, h in zip(share, hs, strict=True))
        assert abs(got - sig(float(z @ w["c"]) + float(w["b"][0]))) < 1e-9


def test_passages_see_words():
    texts = ["alpha beta gamma delta", "kappa zeta omega theta"]  # of one shape
    x = np.concatenate([quality_classifier.passages(c)[0] for t in texts for c in quality_classifier.chunks(sentence_pieces.pa.array([t]))])
    assert np.allclose(x[0, 11:13], x[1, 11:13]) and not np.allclose(
        x[0, -quality_classifier.BUCKETS :], x[1, -quality_classifier.BUCKETS :]
    )


def test_machine_by_plain_loops():
    rng = np.random.default_rng(4)
    k = 40
    machine = toxicity.Machine(-0.3, rng.normal(size=k), rng.normal(size=(k, 4)), np.arange(0, 2 * k, 2))
    bags = [[], [0], [0, 2, 6, 8], [1, 3], [4, 5, 78]]
    got = machine.logits(np.array(sum(bags, [])), np.append(0, np.cumsum([len(b) for b in bags])))
    for bag, value in zip(bags, got, strict=True):
        slots = [b // 2 for b in bag if b % 2 == 0]
        want = -0.3 + sum(machine.w[i] for i in slots) + sum(
            machine.v[i] @ machine.v[j] for n, i in enumerate(slots) for j in slots[n + 1 :]
        )
        assert abs(want - value) < 1e-9


def test_labelled_samples_are_bounded(spark):
    from lexspark.llm import labelled

    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "concat('t', id) AS text"
    ).unionByName(spark.createDataFrame([(1, "a"), (1, None)], "doc_id long, text string"))
    labels = spark.range(3000).selectExpr(
        "id AS doc_id", "cast(id % 2 AS int) AS y"
    ).unionByName(spark.createDataFrame([(None, 1), (5, None), (9999, 1)], "doc_id long, y int"))
    few = labelled.sample(docs, labels, "y", 4, 2, 200).collect()
    assert 150 <= len(few) <= 200
    every = labelled.sample(docs, labels, "y", 4, 2, 5000).collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(3000)) and ("a", 1) in {tuple(r) for r in every}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op9_substring_dedup"])
def test_queries_with_sql(spark, name):
    documents = read(spark, DATA, "documents")
    got = registry.QUERIES[name](spark, DATA)
    kinds = {
        "op1_quality_rules": {"n_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op9_substring_dedup": {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    }
    assert {c: dict(got.dtypes)[c] for c in kinds[name]} == kinds[name]
    same_as_sql(spark, documents, got, registry.ORACLES[name])


def test_near_duplicate_query(spark):
    rows = pairs(read(spark, DATA, "documents"))
    got = registry.QUERIES["op8_minhash_dedup"](spark, DATA)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows, 85)


def test_sentence_piece_query(spark):
    want = {d: (len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in pairs(read(spark, DATA, "documents"))}
    assert {r.doc_id: (r.n_chars, r.decoded_sha256) for r in registry.QUERIES["op2_sentencepiece"](spark, DATA).collect()} == want


def test_stages_take_awkward_rows(spark, docs):
    import corpus_pipeline

    rows = docs.select(
        "doc_id", "text", "lang", "source", "n_chars"
    ).unionByName(spark.createDataFrame(
        [
            (None, "no id " * 30, None, None, None), (None, None, None, None, None),
            (7, "a second text of an id " * 9, "en", "s0", 3)
        ],
        "doc_id long, text string, lang string, source string, n_chars long"
    ))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, DATA)
        assert name == "packing" or got.columns == rows.columns, name
        assert 0 < got.count() and stage(spark, rows.limit(0), DATA).count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    docs = read(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
