import hashlib
import textwrap
import zlib

import numpy as np

from labframe.llm import license_scan, media

from .conftest import corpus, prose


def copyright(words):
    return words[:1] == ["copyright"] or (words[:1] == ["c"] and (words[1:2] == ["copyright"] or words[1:2] and words[1].isdigit()))


def brute(text, dice=0.9, templates=license_scan.TEMPLATES):
    out, lines = [], text.split("\n")
    words = [license_scan.re.findall("[a-z0-9]+", line.lower()) for line in lines]
    kept = [[] if copyright(w) else w for w in words]
    units = [(i, " ".join(w)) for i, w in enumerate(words)] + ([(-1, " ".join(sum(kept, [])))] if len(lines) > 1 else [])
    firsts = [license_scan.re.findall("[a-z0-9]+", t.lower())[:2] for _, t in templates]
    begins = {pair for f in firsts for pair in zip(f, f[1:])}
    for i, w in enumerate(kept):
        if begins & set(zip(w, w[1:])):
            units += [(i, " ".join(sum(kept[i : j + 1], []))) for j in range(i + 1, len(lines)) if kept[j]]
    for at, unit in units:
        a = set(license_scan.word_pairs(unit))
        for k, (_, t) in enumerate(templates):
            b = set(license_scan.word_pairs(t))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= dice:
                out.append((at, k))
    return sorted(set(out))


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licences_are_those_of_all_comparisons(spark):
    apache, mit = license_scan.TEMPLATES[1][1], license_scan.TEMPLATES[5][1]
    texts = [f"{prose(1, 40)}\nReleased under the MIT License.\n{prose(2, 40)}", apache, apache.replace("agreed", "granted"), mit.replace(". ", ".\n"), "MIT", "", None, "licensed under cc by nc 4 0\nAll rights reserved.", prose(3, 5000), "word " * 400]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    got = license_scan.matches(df).collect()
    want = {i: brute(t) for i, t in enumerate(texts) if t and brute(t)}
    found = {}
    for r in got:
        found.setdefault(r.id, set()).add((r.line, r.template))
    assert {i: sorted(v) for i, v in found.items()} == want
    assert {r.doc_id for r in license_scan.licenses(df).collect()} == set(want) and license_scan.licenses(df.where("doc_id < 0")).count() == 0


def test_a_notice_repeated_often_is_found(spark):
    mit = license_scan.TEMPLATES[5][1]
    texts = ["\n".join([mit] * 200), " ".join([mit] * 200)]
    got = license_scan.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {(r.id, r.line, r.template) for r in got} == {(i, *m) for i, t in enumerate(texts) for m in brute(t)}
    assert {(r.id, r.line) for r in got} >= {(0, -1), (1, 0)}


def test_headers_over_lines_and_full_licences_are_found(spark):
    apache, mit, bsd = license_scan.TEMPLATES[1][1], license_scan.TEMPLATES[6][1], license_scan.TEMPLATES[8][1]
    owner = "Copyright (c) 2024 " + "Some Holder With A Long Name " * 6
    texts = [f"/*\n{wrapped(apache, 70, ' * ')}\n */\nint main() {{\n{prose(5, 300)}", f"MIT License\n\n{owner}\n\n{mit}", f"{prose(6, 90)}\n{prose(7, 80)}\n{wrapped(bsd, 80, '# ')}\n{prose(8, 60)}", f"(c) 2020 me\n\n{wrapped(mit, 60)}\n\n{prose(9, 400)}", f"{prose(10, 20)}\nThis program is\nmuch fun\n{prose(11, 10)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {(r.id, r.line, r.template) for r in license_scan.matches(df).collect()}
    assert found == {(i, *m) for i, t in enumerate(texts) for m in brute(t)}
    assert {(i, k) for i, _, k in found} >= {(0, 1), (1, 6), (2, 8), (3, 6)} and {i for i, *_ in found} == {0, 1, 2, 3}


def test_repeated_rows_and_a_very_long_line(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "All rights reserved."), (2, prose(4, 100_000) + "\nAll rights reserved.")]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.licenses, r.lines) for r in got.collect()) == [(0, "Proprietary", "0"), (1, "MIT", "0"), (1, "MIT", "0"), (2, "Proprietary", "1")]


def test_a_template_of_many_words_and_few_pairs(spark):
    """Legal texts repeat themselves: 372 words with 52 pairs are found inside a longer file as well."""
    clause = "permission is granted to use copy and sell this work or any part of it to any one who keeps this notice and the name of its maker with each copy so made".split()
    words = (clause[:13] + clause[:13] + clause) * 5
    words = (words + ["no", "warranty", "is", "given", "by", "the", "maker", "nor", "by", "any", "one", "who", "sells", "it", "on"] + clause)[:372]
    templates = [("X", " ".join(words)), ("Y", "some other notice of twelve words that none of these texts has inside")]
    assert len(words) > 300 and len(license_scan.word_pairs(templates[0][1])) < 60
    texts = [templates[0][1], f"{prose(1, 60)}\n{wrapped(templates[0][1], 60)}\n{prose(2, 300)}", wrapped(templates[0][1], 40, "* ") + "\n" + prose(3, 30), f"{prose(4, 900)}"]
    found = {(r.id, r.line, r.template) for r in license_scan.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), templates=templates).collect()}
    assert found == {(i, *m) for i, t in enumerate(texts) for m in brute(t, templates=templates)} and {i for i, *_ in found} == {0, 1, 2}


def test_texts_of_many_starts(spark):
    import time

    gpl = license_scan.TEMPLATES[2][1]
    poem = "\n".join(f"this work x{i % 7}" for i in range(1500))
    texts = [poem, poem.replace("this work", "this program"), f"{poem}\n{wrapped(gpl, 30)}\n{poem}", "\n".join(["this work is licensed under"] * 300)]
    began = time.perf_counter()
    import pyarrow as pa

    got = license_scan.scanned(pa.array(texts), license_scan.Templates(license_scan.TEMPLATES, 0.9))
    assert time.perf_counter() - began < 4
    few = [f"{chr(10).join(t.split(chr(10))[1490:1530])}" for t in texts]
    found = license_scan.scanned(pa.array(few), license_scan.Templates(license_scan.TEMPLATES, 0.9))
    assert {(r, line, k) for r, line, k, _ in found} == {(i, *m) for i, t in enumerate(few) for m in brute(t)} and {r for r, *_ in got} == {2}


def test_random_texts_of_template_words(spark):
    import random

    import pyarrow as pa

    r = random.Random(8)
    templates = [(f"T{i}", " ".join(r.choice("abc") for _ in range(n))) for i, n in enumerate((2, 4, 9, 20))]
    texts = ["".join(r.choice(["a ", "b ", "c ", "a ", "b ", "\n", "copyright ", "é"]) for _ in range(r.randrange(60))) for _ in range(400)]
    got = license_scan.scanned(pa.array(["no", *texts])[1:], license_scan.Templates(templates, 0.5))
    assert {(i, line, k) for i, line, k, _ in got} == {(i, *m) for i, t in enumerate(texts) for m in brute(t, 0.5, templates)} and len(got) > 200


def test_size_bounds_drop_no_match():
    for n in range(1, 60):
        lo, hi = license_scan.bounds(n, 0.9)
        assert all((lo <= m <= hi) == (2 * min(n, m) / (n + m) >= 0.9 - 1e-12) for m in range(1, 90))


def test_media_is_rebuilt_and_verified(docs, none, twice):
    texts = dict(corpus())
    files = media.store(docs)
    rows = {r.doc_id: r for r in media.features(files).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        p, r = media.payload(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.wave(p)), hashlib.sha256(media.wave(p)).hexdigest())
    assert rows[20].feature == rows[40].feature and rows[4].media_sha256 == rows[6].media_sha256
    kept = [d for f in files.collect() for d, k in zip(f.digests, f.kept, strict=True) if k]
    assert len(kept) == len(set(kept)) and not all(k for f in files.collect() for k in f.kept)
    assert media.store(none).count() == 0
    assert media.features(media.store(twice)).count() == 2 * len(texts) + 1


def test_the_shuffled_way_gives_the_same(docs):
    some = docs.where("doc_id <> 7")
    a = sorted(map(str, media.features(media.store(some, few=0)).collect()))
    assert a == sorted(map(str, media.features(media.store(some)).collect()))


def test_cuts_are_those_of_a_plain_rolling_hash():
    def plain(data):
        h, start, ends = 0, 0, []
        for i, byte in enumerate(data):
            h = ((h << 1) + int(media._GEAR[byte])) % 2**32
            n = i + 1 - start
            if n == media.MOST and i + 1 < len(data) or n >= media.LEAST and h >> (32 - media.CUT_BITS) == 0:
                ends.append(i + 1)
                start = i + 1
        return ends if ends and ends[-1] == len(data) else [*ends, len(data)]

    r = np.random.default_rng(6)
    for data in (r.integers(97, 122, 40_000, np.uint8).tobytes(), b"ab" * 9000, b"x" * 70, prose(8, 3000).encode(), bytes(media.MOST)):
        assert media.cuts(data) == plain(data)


def test_cuts_follow_the_content():
    data = np.random.default_rng(4).integers(97, 122, 60_000, np.uint8).tobytes()
    whole, moved = {c for _, c in media.chunks(data)}, {c for _, c in media.chunks(b"some new words" + data)}
    assert b"".join(c for _, c in media.chunks(data)) == data
    assert len(whole & moved) > 0.8 * len(whole) and all(len(c) <= media.MOST for c in whole)
    assert [len(c) for _, c in media.chunks(b"\0" * 20_000)] == [8192, 8192, 3616] or sum(len(c) for _, c in media.chunks(b"\0" * 20_000)) == 20_000
