"""Spelling variants, the manifest with its versions, and archives, against plain Python on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from eventlink.llm import merkle, spelling, warc


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def plain_variants(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    links = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: links[w][0] for w in n if links[w] and n[links[w][0]] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return Counter(out)


def test_variants(spark, odd, none):
    rows = [(k, "") for k in range(3)]
    said = {"separate": 900, "seperate": 150, "sepperate": 25, "seperatee": 5, "separated": 30, "SEPARATE": 7, "Éclair": 40, "éclair": 8, "eclair": 6}
    said |= {"abcdef": 5, "abcdeg": 5, "bbcdef": 30, "abcdefg": 25, "aabcde": 9, "aaabcde": 50, "aaaaaa": 6, "aaaaaaa": 31, "aaaaaaaa": 200}
    rows += [(k, " ".join([w] * n)) for k, (w, n) in enumerate(said.items())]
    long = "q" * 70_000
    rows += [(9, f"{long} " * 6 + f"{long}r " * 31), (None, "nullid " * 5 + "nullids " * 25), (None, None)]
    # A crowded digest: 900 words alike but for two letters in one place.
    letters = "abcdefghijklmnopqrstuvwxyzàáâã"
    rows += [(50 + k, " ".join(f"crowdwor{a}{b}ds " * (5 + (k * 7 + j) % 40) for j, b in enumerate(letters))) for k, a in enumerate(letters)]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    want = plain_variants(rows)
    for side in (spelling.SIDE, 60):
        assert Counter(tuple(r) for r in spelling.variants(frame, side).collect()) == want
    assert any(r[1] is not None and r[1] != r[2] for r in want)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in spelling.variants(odd).collect()) == plain_variants(texts)
    assert spelling.variants(none).count() == 0


def test_near_words_are_found_once(spark):
    words = ["aabbcc", "aabbc", "aabcc", "abbcc", "aabbccc", "aaabbcc", "xaabbcc", "aabbcx", "abbccd", "aabb", "aabbccdd"]
    words = [f"{w}{'z' * k}" for w in words for k in (1, 4, 9)]
    frame = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    for side in (spelling.SIDE, 3):
        got = Counter((r.word, r.near) for r in spelling.links(frame, side).collect())
        assert got == Counter((a, b) for a in words for b in words if near(a, b))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(doc, text, lang, source, n):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, k):
        for level in levels[:-1]:
            yield (level[k ^ 1] if k ^ 1 < len(level) else ""), k & 1
            k >>= 1

    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        tampered = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups[lang].append((doc, leaf(doc, text, lang, source, n), leaf(doc, text, lang, source, n + tampered if n is not None else None)))
    for found in groups.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[1] for r in groups[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, (doc, node, changed) in enumerate(groups[g]):
            steps = [*way(trees[k], i), *way(top, k)]
            for sibling, right in steps:
                changed = H(sibling, changed) if right else H(changed, sibling)
            root = top[-1][0]
            out.append((doc, node, trees[k][-1][0], root, H(*(s for s, _ in steps)), changed, changed == root))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 3, merkle.HEIGHT])
def test_manifest(spark, odd, height):
    rows = [(k, f"text {k}", ("en", "de", "zz", "é")[0 if k % 3 else k % 4], "s", None if k % 11 == 0 else k) for k in range(150)]
    rows += [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()] + [(7, None, "", None, None), (1, "alone", "only", "s", 1)]
    frame = spark.createDataFrame([(*r, "k", "n", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, node string, pos int")
    got = merkle.verify(frame.repartition(5), height)
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)


def test_manifest_of_little(spark, odd, none):
    assert merkle.verify(none).count() == 0
    one = merkle.verify(odd.where("doc_id = 5")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H() and one.verified


def test_versions_share_their_nodes(spark):
    nodes = [H(str(k)) for k in range(37)]
    block = merkle.Block(nodes, 6, True)
    before = [list(level) for level in block.levels]
    copies = block.version(20, H("other"))
    assert len(copies) == len(block.levels) and block.levels == before
    changed = merkle.Block([*nodes[:20], H("other"), *nodes[21:]], 6, True)
    assert [level[20 >> k] for k, level in enumerate(changed.levels)] == copies
    differing = sum(a != b for x, y in zip(block.levels, changed.levels, strict=True) for a, b in zip(x, y, strict=True))
    assert differing == len(copies)


BIG = "x\r\n" * 1000 + "é" * 50_000
PAGES = [
    (1, "http://a/\r\nb", BIG),
    (2, None, BIG),
    (3, "u", None),
    (4, "u", ""),
    (None, "u", "\r\n\r\n"),
    (None, "v", "\r\n"),
    (None, "v", "\r\n"),
    (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (7, "u", "a\r"),
    (8, "u", "\r\r\n\r\n\r"),
    (-9, "u", "a\r"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "c") for p in PAGES], "page_id long, url string, html string, chunk int, record string").repartition(3)


def test_archives(spark, pages):
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = Counter()
    for html in {p[2] or "" for p in PAGES}:
        ids = sorted((p[0] for p in PAGES if (p[2] or "") == html), key=lambda k: (k is None, -(k or 0)))
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        for k, page in enumerate(ids):
            want[page, len(html.encode()), digest, "revisit" if k else "response", ids[0] if k else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 1000, warc.CHUNK])
def test_chunks_of_archives(spark, pages, tmp_path, size):
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder, size)
    read = warc.read_archives(spark, folder, size).collect()
    found = defaultdict(list)
    for r in sorted(read, key=lambda r: r.chunk):
        found[r.record_id].append(r)
    assert len(found) == len(PAGES)
    payloads = Counter()
    for rows in found.values():
        assert [r.chunk for r in rows] == list(range(len(rows))) and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
        whole = b""
        for r in rows:
            assert len(r.payload) <= size
            whole += r.payload
            assert (r.n_bytes, r.sha1) == (len(whole), base64.b32encode(hashlib.sha1(whole).digest()).decode())
        if rows[0].record_type == "response":
            payloads[whole.decode()] += 1
    assert payloads == Counter({p[2] or "" for p in PAGES})


def test_broken_archives_are_told(spark):
    def record(payload, digest):
        http = warc.HTTP.encode() + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + warc.BLANK

    good = record(b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode())
    parser = warc.Parser(2)
    assert [r[7] for k in range(len(good)) for r in parser.feed(good[k : k + 1])] == [b"ab", b"c"]
    parser.close()
    with pytest.raises(ValueError, match="digest"):
        list(warc.Parser(2).feed(record(b"abc", "A" * 32)))
    cut = warc.Parser(2)
    list(cut.feed(good[:-8]))
    with pytest.raises(ValueError, match="ends within"):
        cut.close()


def test_oversized_payloads_pass_in_pieces():
    rows = warc.Rows(warc.CHUNKS)
    piece = b"x" * warc.CHUNK
    batches = [b for k in range(20) for b in rows.add(piece, 0, 1, "u", k, piece, k, "s", "s", False)]
    assert max(b.nbytes for b in batches) < 2 * warc.BATCH and isinstance(batches[0], pa.RecordBatch)
