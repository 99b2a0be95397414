import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from undertow.llm import bpe, components, html, jpeg, licenses, lines, packing, quality, secrets, simhash, substrings

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "x"), (-5, "x"), (-6, "é ß 😀\n\n"), (None, "without an id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", 7, 1, "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, removed string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, common = line(50), line(9)
    rows = list(ODD)
    for i in range(60):
        parts = [line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if i % 3 == 0:
            parts.append(common)
        rows.append((i, "\n".join(parts)))
    rows += [(100 + k, rows[10][1]) for k in range(5)]
    rows += [(200 + k, rows[12][1].replace(vocabulary[k], vocabulary[k + 1], 1) + " " + vocabulary[k]) for k in range(8)]
    rows += [(300, "a b c " * 60), (301, "loop " * 80)]
    return rows


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    known, own, rng = Tokenizer.from_file(VOCAB), bpe.Codec(VOCAB), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "ß", "　", "\x1c", "😀", "²", "'s", "'", "==", "in", "ing", "tion", "<|endoftext|>", "日本", "\r\n", "Ⅷ", "\x00", "\x85", "Z"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["".join(rng.choices("abcdeinorst", k=70)) for _ in range(200)] + [c * n for c in "ae =-" for n in range(1, 90)]
    for text, ids in zip(texts, own.encode_all(texts)):
        expected = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected and own.decode(ids) == known.decode(expected, skip_special_tokens=False)


def test_packing_ids_equal_the_library_whatever_is_stored():
    from tokenizers import Tokenizer

    library, encoder, rng = Tokenizer.from_file(VOCAB), packing.LibraryEncoder(VOCAB), random.Random(4)
    encoder.most_known = 60
    words = ["the", "naïve", "l'été", "don't", "日本語", "x\u00a0y", "12,5%", "\t", "<|endoftext|>", "\x00\x7f", "a.b_c", "😀", "ünder,"]
    chunks = [["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", " \n"]) for _ in range(rng.randint(0, 30))) for _ in range(20)] + [None, "one more"] for _ in range(8)]
    for chunk in chunks:
        for text, ids in zip(chunk, encoder.encode_all(chunk)):
            assert list(memoryview(ids).cast("I")) == library.encode(text or "", add_special_tokens=False).ids
        assert len(encoder.older) + len(encoder.known) < 1500
    assert encoder.older


def test_bpe_rows(spark, corpus):
    docs = frame(spark, corpus)
    rows = {r.doc_id: r for r in bpe.round_trip(docs, VOCAB).collect()}
    for i, text in corpus:
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), VOCAB).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, VOCAB), VOCAB).collect()}
    assert back == {i: t or "" for i, t in corpus}


def test_packing_places_every_id_once(spark, corpus):
    size = 64
    rows = packing.pack(frame(spark, corpus), VOCAB, size=size).collect()
    codec, by_doc, by_sequence = bpe.Codec(VOCAB), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in corpus:
        ids, at = codec.encode(text) + (1).to_bytes(4, "little"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert at == len(ids) // 4
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(frame(spark, corpus).limit(0), VOCAB).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {2048: 3}, {1000: 5, 1048: 5}, {700: 1000, 300: 10, 5: 3}])
def test_plan_holds_the_histogram(histogram):
    plan = packing.plan(histogram, 2048)
    held = Counter()
    for pattern, count in plan:
        assert sum(pattern) <= 2048
        for length in pattern:
            held[length] += count
    assert held == Counter(histogram)


def test_statistics_equal_brute_force(spark, corpus):
    rows = {r.doc_id: r for r in quality.judge(frame(spark, corpus), []).where("n_words < 50 OR kept OR NOT kept").collect()}
    for i, text in corpus:
        w = words(text)
        found = Counter(zip(w, w[1:], w[2:]))
        covered = [any(0 <= k <= len(w) - 3 and found[tuple(w[k : k + 3])] > 1 for k in (j - 2, j - 1, j)) for j in range(len(w))]
        own = [x for x in (text or "").split("\n") if words(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(own) - len(set(own)), sum(covered))
        assert r.base_failed == (len(w) < 50 or 100 * sum(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
        assert r.removed == "kept"


def test_rules_learn_a_threshold_and_leave_good_rows(spark):
    rng = random.Random(1)
    rows = [({"a": rng.random(), "b": rng.random()}, False) for _ in range(600)]
    rows = [(v, v["a"] > 0.8 and v["b"] <= 0.5) for v, _ in rows]
    rules = quality.learn(rows, ("a", "b"))
    wrong = sum(any(quality.holds(r, v) for r in rules) != bad for v, bad in rows)
    assert rules and wrong <= 12
    assert quality.learn([(v, False) for v, _ in rows], ("a", "b")) == [] and quality.learn([], ("a",)) == []
    docs = frame(spark, ODD)
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []


def test_secrets_equal_the_patterns_and_add_formats(spark):
    hexes = "24be64439e3e49cf46b2d7c90f3602a3"
    texts = [*ODD, (1, f'token = "{hexes}" x'), (2, "token=token=abcdefghijklmnop"), (3, "token=secret:abcdefghijkl"), (4, "AKIAABCDEFGHIJKLMN AKIAX"), (5, "API_KEY: AbC/+=.-_0123 paſsword: abcdefghijklmnop"), (6, "put " + secrets.labelled_credentials(1, seed=3)["github"][0] + " here"), (7, "a plain-text-with-many-parts-2024 and www.example.com/some/page/12.html")]
    rows = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect()}
    assert rows[1].spans == "assign:0:41,hex:9:41" and rows[2].spans == "assign:0:28" and rows[3].spans == ""
    assert rows[4].spans == "access:0:18" and (rows[5].n_assign, rows[6].n_inferred, rows[7].spans) == (1, 1, "")
    assert rows[6].spans.startswith("github:4:") and rows[-1].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in secrets.redact(frame(spark, texts)).collect()}
    assert masked[1].text == '[secret]" x' and masked[1].n_chars == 11 and masked[7].text == texts[-1][1] and masked[-1].text is None


def test_automata_tell_formats_from_ordinary_strings():
    scanner = secrets.scanner()
    fresh = secrets.labelled_credentials(each=50, seed=99)
    for name, strings in fresh.items():
        flagged = sum(scanner.margin(s)[0] > scanner.threshold for s in strings) / len(strings)
        assert flagged <= 0.01 if name == "ordinary" else flagged >= 0.95


def test_substrings_equal_brute_force(spark, corpus):
    rows = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, corpus)).collect()}
    known = {i: words(t) for i, t in corpus if i is not None}
    found = Counter(tuple(w[k : k + 35]) for w in known.values() for k in range(len(w) - 34))
    assert max(found.values()) > 1
    for i, w in known.items():
        gone = set()
        for k in range(len(w) - 34):
            if found[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert rows[None].n_removed == 0 and substrings.remove_repeats(frame(spark, corpus).limit(0)).count() == 0


def test_cover_meets_every_difference():
    cover = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


def test_keys_never_miss_three_bits():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 600, dtype=np.uint64)
    for errors in (1, 2, 3):
        other = one.copy()
        for k in range(len(other)):
            for bit in rng.choice(64, errors, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(bit)
        own, asks = defaultdict(set), defaultdict(set)
        for key, fp, ask in zip(*(x.tolist() for x in simhash.keys(np.concatenate([one, other])))):
            (asks if ask else own)[fp].add(key)
        assert all(own[a] & asks[b] for a, b in zip(one.tolist(), other.tolist()))


def test_near_duplicates_equal_brute_force(spark, corpus):
    import xxhash

    rows = simhash.near_duplicates(frame(spark, corpus)).collect()
    known = sorted((i, t) for i, t in corpus if i is not None)
    prints = []
    for _, text in known:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = union_find(len(known), [(a, b) for a in range(len(known)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for (i, _), root in zip(known, roots):
        least[root] = min(i, least.get(root, i))
    expected = {i: (f"{p:016x}", least[root]) for (i, _), p, root in zip(known, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows if r.doc_id is not None} == expected
    assert len(rows) == len(corpus) and simhash.near_duplicates(frame(spark, corpus).limit(0)).count() == 0


def test_smallest_fingerprint_without_the_smallest_id_joins_its_component(spark):
    base = " ".join(f"w{k}" for k in range(300))
    texts = [base] + [base.replace(f"w{k} ", f"v{k} ", 1) for k in range(5, 295, 5)]
    signed = lambda t: (f := simhash.fingerprint(t)) - (f >> 63 << 64)
    near = [(a, b) for a in texts for b in texts if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3]
    low, high = next((a, b) for a, b in near if signed(a) < signed(b))
    docs = frame(spark, [(3, high), (4, low), (9, low), (7, "another text of its own")])
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows == {3: 3, 4: 3, 9: 3, 7: 7}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [3, 7]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    rows = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(rows[k] == 0 for k in range(1, 41)) and all(rows[100 + k] == 100 for k in range(1, 50)) and 0 not in rows
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_equal_brute_force(spark, corpus):
    rows = {r.doc_id: r for r in lines.report(frame(spark, corpus)).collect() if r.doc_id is not None}
    places = defaultdict(list)
    for i, text in sorted((i, t) for i, t in corpus if i is not None):
        for k, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= lines.LEAST:
                places[line].append((i, k))
    known = sorted(places, key=lambda x: places[x][0])
    sets = [{x[k : k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} or {x} for x in known]
    linked = [(a, b) for a in range(len(known)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = defaultdict(set)
    for k, (line, root) in enumerate(zip(known, union_find(len(known), linked))):
        for place in places[line]:
            if root != k or place != places[line][0]:
                gone[place[0]].add(place[1])
    got = {i: {int(x) for x in r.removed_lines.split(",") if x} for i, r in rows.items()}
    missing, extra = sum(len(gone[i] - got[i]) for i in got), sum(len(got[i] - gone[i]) for i in got)
    assert linked and extra == 0 and missing <= 0.05 * sum(map(len, gone.values()))


def test_short_and_unspaced_lines_meet(spark):
    rng = random.Random(9)
    pick = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    pairs = [("Read more about cookies", "Xead more about cookies"), ("=" * 90 + "a", "=" * 90)]
    pairs += [(line, line[:-1]) for line in (pick(36) for _ in range(30))]
    pairs += [(line, line[1:]) for n in range(16, 40) for line in ["".join(rng.choices("abcdefgh", k=n))]]
    sets = [[{x[k : k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} for x in p] for p in pairs]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in sets]
    docs = frame(spark, [(k * 2 + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)])
    gone = {r.doc_id for r in lines.report(docs).collect() if r.n_removed}
    assert near[0] and sum(near) > 50 and gone == {2 * k + 1 for k, n in enumerate(near) if n}


def template_lines(seed, groups=200):
    """Pairs of lines near 0.8, all of which share three quarters of a template: bands of hundreds of components."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    head, out = " ".join(word() for _ in range(45)), []
    for _ in range(groups):
        own = [word() for _ in range(15)]
        other = own[:-5] + [word() for _ in range(5)]
        out += [f"{head} {' '.join(own)}", f"{head} {' '.join(other)}"]
    return out


def links_of(spark, known):
    """Pairs of lines at 0.8 by brute force: all, and those that share a band; and the lines of the largest band."""
    sets = [{x[k : k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} for x in known]
    near = [(a, b) for b in range(len(known)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = frame(spark, list(enumerate(known)))
    names = {r.h1: r.doc_id for r in lines.occurrences(docs).select("h1", "doc_id").collect()}
    bands = {}
    for r in lines.signatures(docs).collect():
        t = [r[f"t{i}"] for i in range(lines.TRIPLES)]
        bands[names[r.h1]] = {x ^ y for k, x in enumerate(t) for y in t[:k]} | {r[f"x{i}"] for i in range(lines.ROWS)}
    return near, [(a, b) for a, b in near if bands[a] & bands[b]], max(Counter(x for own in bands.values() for x in own).values())


@pytest.mark.parametrize("seed", [2, 4])
def test_large_bands_lose_no_pair(spark, seed):
    known = template_lines(seed)
    near, banded, largest = links_of(spark, known)
    gone = {r.doc_id for r in lines.report(frame(spark, list(enumerate(known)))).collect() if r.n_removed}
    roots = lambda links: {k for k, root in enumerate(union_find(len(known), links)) if root != k}
    assert largest > 100 and len(banded) > 50 and roots(banded) <= gone <= roots(near)


def test_large_bands_meet_by_what_is_rare_in_their_family(spark, monkeypatch):
    rng, met, possible = random.Random(6), [], lines.possible
    vocabulary, known = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(250)], []
    for _ in range(5):
        base = rng.choices(vocabulary, k=60)
        for _ in range(60):
            own = list(base)
            for k in rng.sample(range(60), 8):
                own[k] = rng.choice(vocabulary)
            known.append(" ".join(own))

    def counted(left, right, similarity):
        met.append(lines.side(left, "a").join(lines.side(right, "b"), "key").where("aof <> bof").count())
        return possible(left, right, similarity)

    monkeypatch.setattr(lines, "possible", counted)
    near, banded, largest = links_of(spark, known)
    gone = {r.doc_id for r in lines.report(frame(spark, list(enumerate(known)))).collect() if r.n_removed}
    roots = lambda links: {k for k, root in enumerate(union_find(len(known), links)) if root != k}
    assert largest > lines.ALL and roots(banded) <= gone <= roots(near) and 0 < sum(met) < 12 * len(known), met


def test_pipeline_stage_loses_no_pair_of_large_bands(spark):
    import corpus_pipeline

    known = template_lines(2)
    near, banded, largest = links_of(spark, known)
    kept = corpus_pipeline.fresh_lines(spark, frame(spark, list(enumerate(known))), "").collect()
    gone = {r.doc_id for r in kept if not r.text}
    roots = lambda links: {k for k, root in enumerate(union_find(len(known), links)) if root != k}
    assert largest > 100 and len(kept) == len(known) and roots(banded) <= gone <= roots(near)


def test_further_links_walk_only_what_they_touch(spark, monkeypatch):
    rng, walked = random.Random(7), []
    first = [(k, k + 1) for k in range(0, 400) if k % 5 != 4] + [(500, 900), (700, 900)]
    more = [tuple(sorted(rng.sample(range(1000), 2))) for _ in range(60)] + [(900, 950), (3, 500)]
    near = components.components(spark.createDataFrame(first, "a long, b long"))
    monkeypatch.setattr(lines, "components", lambda links: walked.append(links.count()) or components.components(links))
    rows = lines.joined(near, spark.createDataFrame(more, "a long, b long")).collect()
    roots = union_find(1000, [(b, a) for a, b in first + more])
    assert {r.node: r.component for r in rows} == {k: root for k, root in enumerate(roots) if root != k}
    assert len(rows) == len({r.node for r in rows}) and walked == [len(more)]


def test_only_lines_of_mixed_bands_get_bitmaps(spark, monkeypatch):
    rng, asked, build = random.Random(3), [], lines.bitmaps
    known = [w + s for w in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(20)) for s in ("one", "two")]
    monkeypatch.setattr(lines, "bitmaps", lambda texts: asked.append(texts.count()) or build(texts))
    gone = {r.doc_id for r in lines.report(frame(spark, list(enumerate(known)))).collect() if r.n_removed}
    assert gone == set(range(1, 40, 2)) and asked == [0]


def test_lines_move_uncoded():
    assert "encode(line" in lines.hashed("line")


def test_pipeline_packs_with_smaller_stores(monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "pack", lambda docs, path, **memory: memory)
    assert corpus_pipeline.packed(None, None, "")["known"] < bpe.CACHE // 2


def test_kept_lines_keep_columns(spark):
    docs = frame(spark, [(1, "one line of some length here\nand another line that is long"), (2, "something else entirely here\none line of some length here"), (3, None)])
    rows = {r.doc_id: r for r in lines.drop_lines(docs).collect()}
    assert rows[2].text == "something else entirely here" and rows[2].n_chars == 28 and rows[2].removed == "kept"
    assert rows[1].n_chars == 7 and rows[3].text is None


@pytest.mark.parametrize("payload", [bytes(64), b"\xff" * 640, bytes(range(256)) * 3])
def test_jpeg_round_trip_by_both_decoders(payload):
    media = jpeg.encode(payload)
    stored, image, blocks = jpeg.read(media)
    assert stored == payload and (image.walk() == blocks).all() and image.width % 8 == 0


def test_jpeg_rows(spark, corpus):
    rows = {r.doc_id: r for r in jpeg.store_and_read(frame(spark, corpus)).collect()}
    assert rows == {r.doc_id: r for r in jpeg.features(jpeg.store(frame(spark, corpus))).collect()}
    for i, text in corpus:
        data = (text or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert rows[i].payload_sha256 == hashlib.sha256(data).hexdigest() and rows[i].tail_crc32 == zlib.crc32(data[-64:])


def test_html_layout():
    page = "<title>t</title><style>.ad{display:none}</style><div class=ad>no</div><p>One<p>Two <b>b</b>&amp;<br>next<ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>alpha<td>1</table><details><summary>s</summary>not</details><i hidden>h</i>"
    assert html.render(page) == "One\n\nTwo b&\nnext\n\n- a\n- b\n  1. x\n  2. y\n\nName   N\nalpha  1\n\ns"
    assert html.render("<div>" * 5000 + "deep") == "deep" and html.render(None) == "" and html.render("</p>a < b <") == "a < b <"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html.extract(pages).collect()) == [(0, ""), (1, "a"), (2, "")]


def test_licenses_by_alignment(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [*ODD, (1, "x " + mit.replace("merge", "combine") + " y"), (2, "Released under the MIT License. And Licensed under CC BY-NC 4.0."), (3, "a license to nothing, under no version")]
    rows = licenses.scan(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(1, "MIT"), (2, "CC-BY-NC-4.0-line"), (2, "MIT-line")]
    assert licenses.align("a b c d e".split(), "a x c y e".split()) == [(0, 0), (2, 2), (4, 4)]


def test_pipeline_stages_hold(spark, tmp_path, corpus):
    import corpus_pipeline

    long = [(i, t) for i, t in corpus if i is not None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in long], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in long], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    good = {i for i, t in long if len(words(t)) >= 50 and i < 300}
    assert kept <= good and not kept & {300, 301} and len(kept & set(range(100, 105)) | kept & {10 - len(ODD)}) <= 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "secrets", "packing"]


def test_inferred_formats_find_what_patterns_miss(spark):
    rng = random.Random(11)
    held = secrets.labelled_credentials(30, seed=99)  # strings that no automaton was fitted on
    prose = lambda: " ".join("".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randint(2, 11))) for _ in range(30))
    inside = lambda s: f"{prose()} {s} {prose()}"
    hidden = [inside(s) for k, v in held.items() if k != "ordinary" for s in v]
    clean = [inside(s) for s in held["ordinary"]] + [inside(f"user{k}.name{k}@mail{k}.example.com https://www.example.org/a/b-{k}/page_{k}.html") for k in range(200)]
    rows = {r.doc_id: r for r in secrets.scan(frame(spark, list(enumerate(hidden + clean)))).collect()}
    patterns = sum(r.n_assign + r.n_access + r.n_hex > 0 for i, r in rows.items() if i < len(hidden))
    caught = sum(r.spans != "" for i, r in rows.items() if i < len(hidden))
    wrong = sum(r.spans != "" for i, r in rows.items() if i >= len(hidden))
    assert patterns <= 0.1 * len(hidden) and caught >= 0.95 * len(hidden) and wrong <= 0.01 * len(clean), (patterns, caught, wrong)


def test_a_corpus_teaches_its_own_format(spark):
    rng = random.Random(5)
    own = lambda: "zeta-" + "-".join("".join(rng.choices("0123456789", k=4)) for _ in range(4))
    docs = frame(spark, [(k, f'settings {k}\npassword = "{own()}"\nend') for k in range(120)] + [(1000 + k, f"call me with {own()} please") for k in range(40)] + [(2000 + k, f"see build-{k} of 2024-01-{k % 28 + 1:02} and release_notes_v{k}_final") for k in range(40)] + [(3000, None)])
    spans = lambda learned: {r.doc_id: r.spans for r in secrets.scan(docs, learned).collect()}
    before, after = spans(None), spans(secrets.learn(docs))
    assert sum(before[1000 + k] != "" for k in range(40)) <= 4 and sum(after[1000 + k] != "" for k in range(40)) >= 38
    assert not any(after[2000 + k] for k in range(40)) and all(after[k].startswith("assign:") for k in range(120)) and after[3000] == ""
    assert secrets.scan(docs.limit(0), secrets.learn(docs.limit(0))).count() == 0


def canonical(lengths):
    """(code, length) by symbol, by the rule of the standard."""
    out, code, before = {}, 0, 0
    for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[symbol] - before
        before = lengths[symbol]
        out[symbol] = code, before
        code += 1
    return out


def other_encoder(parts, width, height, blocks, restart=0):
    """A picture by a plain encoder of its own: parts (h, v) sampling of components, blocks {component: rows of 64}; tables of several lengths."""
    size = lambda v: abs(v).bit_length()
    dc, ac = canonical({s: n for s, n in zip(range(12), (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9))}), canonical({s: n for s, n in zip((0x00, 0x01, 0x02, 0x03, 0x11, 0xF0, 0x12, 0x04, 0x21, 0x05, 0x31, 0x06, 0x07, 0x08), (3, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16))})
    most = max(p[0] for p in parts), max(p[1] for p in parts)
    units = -(-width // 8) * -(-height // 8) if len(parts) == 1 else -(-width // (8 * most[0])) * -(-height // (8 * most[1]))
    order = [0] if len(parts) == 1 else [k for k, p in enumerate(parts) for _ in range(p[0] * p[1])]
    feeds, scan, bits, before = [iter(blocks[k]) for k in range(len(parts))], bytearray(), "", [0] * len(parts)
    put = lambda table, symbol, v, n: format(table[symbol][0], f"0{table[symbol][1]}b") + (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            byte = int(bits[k : k + 8], 2)
            scan.extend((byte, 0) if byte == 255 else (byte,))
        bits = ""

    for unit in range(units):
        if restart and unit and unit % restart == 0:
            flush()
            scan.extend((0xFF, 0xD0 + (unit // restart - 1) % 8))
            before = [0] * len(parts)
        for k in order:
            block = next(feeds[k])
            d, before[k] = block[0] - before[k], block[0]
            bits += put(dc, size(d), d, size(d))
            run = 0
            last = max((i for i in range(64) if block[i] and i), default=0)
            for v in block[1 : last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15 or run and (run << 4 | size(v)) not in ac:
                    if run < 16:  # a run without a code of its own: shorter ones can't stand for it
                        raise ValueError("pick blocks that the table can code")
                    bits += put(ac, 0xF0, 0, 0)
                    run -= 16
                bits += put(ac, run << 4 | size(v), v, size(v))
                run = 0
            if last < 63:
                bits += put(ac, 0x00, 0, 0)
    flush()
    seg = jpeg.segment
    table = lambda kind, t: bytes([kind, *[sum(n == k for _, n in t.values()) for k in range(1, 17)], *sorted(t, key=lambda s: (t[s][1], s))])
    frame_ = bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(parts)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(parts))
    ahead = bytes([len(parts)]) + b"".join(bytes([k + 1, 0]) for k in range(len(parts))) + bytes([0, 63, 0])
    return b"\xff\xd8" + seg(0xE0, b"other") + seg(0xDB, bytes([0, 3, *[5] * 63])) + seg(0xC0, frame_) + seg(0xC4, table(0x00, dc)) + seg(0xC4, table(0x10, ac)) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, ahead) + bytes(scan) + b"\xff\xd9"


def plain_blocks(rng, n):
    out = []
    for _ in range(n):
        block = [rng.randint(-300, 300)] + [0] * 63
        at = 1
        while at < 64 and rng.random() < 0.9:
            run = rng.choice((0, 0, 0, 1, 2, 3, 16, 32))
            at += run
            if at > 63:
                break
            most = {0: 255, 1: 3, 2: 1, 3: 1}.get(run % 16, 1)
            block[at] = rng.choice((-1, 1)) * rng.randint(1, most if run % 16 == run or run % 16 == 0 else 1)
            at += 1
        out.append(block)
    return out


@pytest.mark.parametrize("parts, width, height, restart", [([(1, 1)], 40, 24, 0), ([(1, 1)], 41, 17, 1), ([(1, 1)], 64, 64, 5), ([(2, 2), (1, 1), (1, 1)], 33, 20, 0), ([(2, 1), (1, 1), (1, 1)], 48, 16, 2)])
def test_jpeg_of_another_encoder(parts, width, height, restart):
    rng = random.Random(width)
    most = max(p[0] for p in parts), max(p[1] for p in parts)
    units = -(-width // 8) * -(-height // 8) if len(parts) == 1 else -(-width // (8 * most[0])) * -(-height // (8 * most[1]))
    blocks = [plain_blocks(rng, units * (p[0] * p[1] if len(parts) > 1 else 1)) for p in parts]
    media = other_encoder(parts, width, height, blocks, restart)
    ((image, got),) = jpeg.decode_many([media])
    assert got.tolist() == blocks[0] and image.walk().tolist() == blocks[0] and (image.width, image.height) == (width, height)
    assert jpeg.stored(image, got) is None and image.thumbnail(got).size == len(blocks[0])


def test_jpeg_features_of_nulls_and_damage(spark):
    good = jpeg.encode(bytes(range(256)) * 4)
    files = [None, b"", b"GIF89a", good[: len(good) // 2], good[:-40] + b"\xff\xd9", good, good.replace(b"\xff\xc0", b"\xff\xc2")]
    rows = {r.doc_id: r for r in jpeg.features(spark.createDataFrame([(k, 1, f) for k, f in enumerate(files)], "doc_id long, n_bytes long, media binary")).collect()}
    assert [rows[k].payload_bytes for k in range(7)] == [None, None, None, None, None, 1024, None]
    assert rows[0].media_bytes is None and rows[3].media_bytes == len(good) // 2 and rows[5].feature.startswith("32x32:")
    assert jpeg.store_and_read(frame(spark, [])).count() == 0


def test_pages_of_any_length_render_in_time():
    long = {"open tags": "<a " * 100_000, "nested": "<div>" * 100_000 + "x", "crossed": "<b>" * 50_000 + "</i>" * 50_000 + "x", "lists": "<ul><li>x" * 20_000, "quotes": "<a \"x>" * 50_000, "in a cell": "<p><table><td>" + "<div>" * 100_000 + "x"}
    began = time.time()
    shown = {name: html.render(page) for name, page in long.items()}
    assert time.time() - began < 60 and shown["open tags"].count("<a") == 100_000 and shown["nested"] == shown["crossed"] == shown["in a cell"] == "x" and shown["lists"].count("x") == 20_000
    assert html.render("<table><tr><td>" + "w" * 3000 + "<td>b<tr><td>a<td>c</table>").split("\n")[1].split() == ["a", "c"]


def test_empty_tables_give_no_rows(spark):
    none = frame(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert not any(q.count() for q in (quality.judge(none, []), quality.keep(none, []), secrets.redact(none), licenses.scan(none), html.extract(pages), lines.report(none), lines.drop_lines(none)))


def test_quality_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text, "mine", "my rule", 99, True), (2, "short", "x", "y", 1, None)], "doc_id long, text string, kept string, rule string, n_words long, base_failed boolean")
    assert [tuple(r) for r in quality.keep(docs, []).collect()] == [(1, text, "mine", "my rule", 99, True)]


def test_rows_of_one_id_keep_their_own_lines(spark):
    same = "one line of some length here, shared by two"
    docs = frame(spark, [(1, same), (2, same + "\nprecious content that occurs once only"), (2, "qqq\n" + same + "\nanother precious line that occurs once"), (None, same)])
    texts = sorted((r.doc_id or 0, r.text) for r in lines.drop_lines(docs).collect())
    assert texts == [(0, same), (1, same), (2, "precious content that occurs once only"), (2, "qqq\nanother precious line that occurs once")]


def test_rules_as_expression_equal_rules_in_python(spark):
    rng = random.Random(3)
    rules = [[("n_words", "<=", 60.0), ("symbols_per_word", ">", 0.1)], [("repeat_share", ">", 0.2)], [("mean_word_length", "<=", 3.5)]]
    docs = frame(spark, [(k, " ".join(rng.choice(("a", "bb", "ccc", "#", "dddd", f"w{k % 7}", "long-word")) for _ in range(rng.randint(1, 150)))) for k in range(150)])
    rows = quality.judge(docs, rules).select("*", *[F.expr(e).alias("_" + f) for f, e in quality.FEATURES.items()]).collect()
    first = lambda r: next((n for n, rule in enumerate(rules, 1) if quality.holds(rule, {f: r["_" + f] for f in quality.FEATURES})), 0)
    assert {r.rule for r in rows} > {0} and all(r.rule == first(r) and r.kept == (not r.base_failed and r.rule == 0) for r in rows)
