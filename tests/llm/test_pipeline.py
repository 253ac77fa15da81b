"""The pipeline's stages and the ten queries against plain Python, on repeated rows, shared and null ids, copies and empty texts."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import test_llm as brute

from gridstrata.llm import queries

A, B, C, D = (" ".join(f"{k}{i * 7 % 97}x{i}" for i in range(120)) for k in "abcd")
SHARED = "One line that is long enough and that five of the documents hold"
NAV = "Home | News | Sport | Contact"
KEY = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(base64.b64encode(bytes([k] * 48)).decode() for k in range(20, 30)) + "\n-----END PRIVATE KEY-----"
ROWS = [
    (5, A), (5, A), (5, A), (9, A + " tail"), (2, B), (2, A + " other"), (8, B + " tail"), (None, C), (None, C), (4, C + " tail"), (None, D), (None, D), (None, ""), (None, None), (20, ""), (20, ""),
    *[(30 + k, f"{SHARED}\n" + " ".join(f"own{k}w{i}" for i in range(30))) for k in range(5)], (33, f"{SHARED}\n" + " ".join(f"z{i}" for i in range(40))),
    (50, f"{NAV}\nwe keep the words of this line because it reads like any other\n{KEY}\npassword = abcdefghijklmn1 and more words"), (51, " ".join(f"long{i}" for i in range(2500))), (52, "same words " * 20), (53, "short"),
]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def py_quality(rows):
    out = []
    for d, t in rows:
        w = brute.split(t)
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {p for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w):
            out.append((d, "\n".join(x for x in t.split("\n") if x != NAV)))
    return out


def py_lines(rows):
    key = lambda x: brute.lower(x.strip(brute.SPACES))
    low = lambda d: -(2**63) if d is None else d
    n, last = Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] += len(k) >= 40
            last[k] = max(last.get(k, low(d)), low(d))
    return [(d, "\n".join(x for x in (t or "").split("\n") if not (n[key(x)] >= 5 and low(d) < last[key(x)]))) for d, t in rows]


def py_roots(rows):
    """The component of each row, as a row's number, and each row's set."""
    own = []
    for _, t in rows:
        w = brute.split(brute.lower(t or ""))
        own.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, x in enumerate(own):
        for j, y in enumerate(own[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root, own


def py_near(rows):
    groups = defaultdict(list)
    for r, row in zip(py_roots(rows)[0], rows, strict=True):
        groups[r].append(row)
    return [by_id(g)[0] for g in groups.values()]


def py_secrets(rows):
    out = []
    for d, t in rows:
        clean, at = "", 0
        for start, _, end, kind in brute.spans(t):
            clean, at = clean + (t[at:start] + f"[{kind}]" if start >= at else ""), max(at, end)
        out.append((d, None if t is None else clean + t[at:]))
    return out


def py_pieces(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    out = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[a : first if k == 0 else a + 2048]
            out.append((d, k, a, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    return Counter(out)


def pieces_of(df):
    rows, by = df.collect(), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en" if k % 2 else "de", "s", None if t is None else len(t)) for k, (d, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d == 52)) for d in {d for d, _ in ROWS if d is not None}], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(d, f"http://x/{d}", t) for d, t in ROWS], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.mark.parametrize(("name", "want"), [("quality_rules", py_quality), ("line_dedup", py_lines), ("near_duplicates", py_near), ("secret_scans", py_secrets)])
def test_stage(spark, folder, name, want):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert by_id((r.doc_id, r.text) for r in got) == by_id(want(ROWS))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_packing_stage_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pieces_of(corpus_pipeline.best_fit_packing(spark, docs, folder)) == py_pieces(ROWS)
    left = py_secrets(py_near(py_lines(py_quality(ROWS))))
    assert pieces_of(corpus_pipeline.run(spark, folder)) == py_pieces(left)


def got(spark, folder, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_queries_with_texts(spark, folder):
    root, own = py_roots(ROWS)
    first = lambda i: by_id([row for r, row in zip(root, ROWS, strict=True) if r == root[i]])[0][0]
    assert Counter(got(spark, folder, "op1_ngram_join")) == Counter((d, len(own[i]), first(i) if own[i] else d) for i, (d, _) in enumerate(ROWS))
    lines = lambda t: len((t or "").split("\n"))
    assert Counter((r[0], r[1], r[3]) for r in got(spark, folder, "op2_line_dedup")) == Counter((d, lines(t), sha(k)) for (d, t), (_, k) in zip(ROWS, py_lines(ROWS), strict=True))
    assert Counter((r[0], r[1], r[6]) for r in got(spark, folder, "op6_quality_rules")) == Counter((d, len(brute.split(t)), (d, t) not in [r for r in ROWS if py_quality([r])]) for d, t in ROWS)
    assert pieces_of(queries.op7_best_fit(spark, folder)) == py_pieces(ROWS)
    spans = lambda t, ranks: ",".join(f"{k}:{a}:{b}" for a, r, b, k in brute.spans(t) if r < ranks)
    n = lambda t: tuple(sum(s[3] == k for s in brute.spans(t)) for k in ("assign", "access", "hex"))
    assert Counter(got(spark, folder, "op10_secret_scan")) == Counter((d, *n(t), sha(spans(t, 3)), spans(t, 9)) for d, t in ROWS)


def test_queries_with_bytes(spark, folder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [enc.encode_ordinary(t or "") for _, t in ROWS]
    assert Counter(got(spark, folder, "op4_byte_bpe")) == Counter((d, len(i), sha(" ".join(map(str, i))), sha(t or "")) for (d, t), i in zip(ROWS, ids, strict=True))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r[0], r[1], r[2]) for r in got(spark, folder, "op5_warc")) == Counter((d, len((t or "").encode()), digest(t)) for d, t in ROWS)
    fill = lambda t: (raw := (t or "").encode()) + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    media = got(spark, folder, "op8_mpeg_ts")
    assert Counter(r[:5] for r in media) == Counter((d, len((t or "").encode()), len(fill(t)), sha(fill(t)), zlib.crc32(fill(t)[-32:])) for d, t in ROWS)
    assert all(r[5] % 188 == 0 for r in media)


def test_queries_with_models(spark, folder):
    part = lambda d, m: zlib.crc32(b"" if d is None else str(d).encode()) % m
    toxic = got(spark, folder, "op3_toxicity")
    assert Counter(r[:2] for r in toxic) == Counter((d, part(d, 3) == 1) for d, _ in ROWS) and all(r[3] == (r[2] >= 0.7) and 0 <= r[2] <= 1 for r in toxic)
    language = got(spark, folder, "op9_language_id")
    assert Counter(r[:2] for r in language) == Counter((d, part(d, 5) == 0) for d, _ in ROWS) and all(r[2] in ("de", "en", "und") and 0 <= r[3] <= 1 for r in language)
