from __future__ import annotations

import random

from hecespark.llm import secrets

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def fresh(seed=99):
    """Credentials that the automata were not inferred from, without their context symbol."""
    return {k: [s[1:] for s in v] for k, v in secrets.labelled(40, seed).items()}


def test_held_out_credentials_are_found():
    found = total = 0
    for kind, values in fresh().items():
        for v in values:
            if kind in secrets.NAMED and len(v) < 24:
                continue  # short mixed values: see test_short_values
            text = f'some words token = "{v}" and more'
            total += 1
            found += any(text[a:b] == v for _, a, b, _, _ in secrets.find([text]))
    assert found / total > 0.97, (found, total)


def test_plain_text_is_left_alone():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 30))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 3000, 50)] + ["INTERNATIONALISATION of 12345678901234567890 at https://example.org/some/long/path/index.html"]
    assert list(secrets.find(texts)) == []


def test_automaton_is_a_distribution():
    import math

    a = secrets.Automaton(["ab", "ab", "ac", "b"])
    for moves, end in zip(a.moves, a.ends):
        total = sum(math.exp(p) for _, p in moves.values()) + (math.exp(end) if end > a.unseen else 0)
        assert abs(total - 1) < 1e-9


def test_merging_generalises():
    a = secrets.automata()["aws_access_key"]
    assert len(a.moves) < 2000
    unseen, wrong = " AKIA" + "Q7ZXW2PLM4RTYB9K", " AKIA" + "q7zxw2plm4rtyb9k"
    assert a.log_likelihood(unseen) > a.log_likelihood(wrong) + 20


def test_scan_and_mask(spark, make):
    text = f'ü token = "{HEX}" end'
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, f"key: {HEX}"), (4, "x " * 300_000 + f"secret={HEX}")]
    for extra in (False, True):
        docs = make(rows, extra)
        got = [(r["doc_id"], r["start"], r["stop"]) for r in secrets.scan(docs).collect()]
        assert sorted(got, key=str) == sorted([(1, 11, 51), (1, 11, 51), (None, 5, 45), (4, 600_007, 600_047)], key=str)
        masked = secrets.mask(docs)
        assert masked.schema == docs.schema
        after = masked.collect()
        assert len(after) == len(rows)
        assert not any(HEX in (r["text"] or "") for r in after)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        assert [r["text"] for r in after if r["doc_id"] == 1] == [f'ü token = "{secrets.MASK}" end'] * 2
    assert secrets.scan(make([])).count() == 0 and secrets.mask(make([])).count() == 0


def test_tokens_of_any_length_are_found():
    rng = random.Random(8)
    url64 = secrets._ALNUM + "-_"
    some = lambda n: "".join(rng.choices(url64, k=n - 1)) + "x"
    for payload in (30, 150, 400, 1500, 5000):
        for signature in (43, 86, 342, 512, 683):
            v = f"eyJ{some(33)}.eyJ{some(payload)}.{some(signature)}"
            assert [(a, kind) for _, a, b, kind, _ in secrets.find([f"cookie {v} end"]) if b - a == len(v)] == [(7, "jwt")], (payload, signature)


def test_credentials_inside_a_run_are_found():
    for kind, values in fresh().items():
        if kind in ("aws_access_key", "github_token", "payment_key", "slack_token"):
            for v in values[:10]:
                for text in (f"see https://host.example/path/{v} now", f"config.{v}", f"x-{v}", f"old_{v}/more-text", f"{values[-1]}.{v}", f"a+{v}.git"):
                    at = text.index(v, 8 if text.startswith(values[-1]) else 0)
                    assert (at, at + len(v)) in [(a, b) for _, a, b, _, _ in secrets.find([text])], (kind, text)


def test_assigned_values_are_found():
    rng = random.Random(4)
    found = 0
    for k in range(200):
        v = "".join(rng.choices(secrets._ALNUM + "+/" * (k % 2), k=38)) + "Z9"
        found += any(text[a:b] == v for text in [f'aws_secret_access_key = "{v}"'] for _, a, b, _, _ in secrets.find([text]))
    assert found >= 196, found
    names = ["password: internationalisation_of_things", "key = some_module.Config2.default_value", "token=src/main/java/org/example/Application.java", "auth 4689387053447877", "secret = MaxPooledConnectionTimeout", "token: 2024-01-15-release-candidate", "key thanonontioniner.", "keys: INTERNATIONALISATION"]
    assert list(secrets.find(names)) == []


def test_lengths_that_no_label_has():
    """Credentials made by other means than the labels, at lengths from short to far beyond those of the labels."""
    import base64
    import hashlib
    import json

    rng = random.Random(12)

    def rate(make, context='api_key = "{}"', n=60):
        texts = [(v, f"some words {context.format(v)} and more") for v in (make() for _ in range(n))]
        return sum(any(t[a:b] == v for _, a, b, _, _ in secrets.find([t])) for v, t in texts) / n

    digest = lambda n: "".join(hashlib.sha512(rng.randbytes(9)).hexdigest() for _ in range(3))[:n]
    for n in (16, 32, 40, 64, 96, 128, 256):
        assert rate(lambda: digest(n)) >= 0.97 and rate(lambda: digest(n).upper()) >= 0.97, n
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    for n in (20, 60, 118, 150, 300, 600, 2000):

        def token():
            claims = json.dumps({"sub": str(rng.random()), "data": url(rng.randbytes(n))[:n]}).encode()
            return f"{url(json.dumps({'alg': 'RS256', 'kid': url(rng.randbytes(6))}).encode())}.{url(claims)}.{url(rng.randbytes(256))}".rstrip("-_")

        assert rate(token, "cookie {}") >= 0.9, n
    secret = lambda: base64.b64encode(rng.randbytes(30)).decode().rstrip("/+")
    assert rate(secret, "aws_secret_access_key = {}", 200) >= 0.95


def test_short_values():
    """Assigned values of 8 characters are candidates; most that mix classes at random are found from 16 on, and none that reads like a name."""
    rng = random.Random(13)
    for n, least in ((12, 0.4), (16, 0.75), (24, 0.93)):
        made = ["".join(rng.choices(secrets._ALNUM, k=n)) for _ in range(200)]
        assert sum(any(b - a == n for _, a, b, _, _ in secrets.find([f"password={v}"])) for v in made) / 200 >= least, n
    assert [(a, b) for _, a, b, _, _ in secrets.find(["pwd: 9f3ab01c2d"])] == [(5, 15)]
    plain = "getUserById2 utf8mb4 sha256sum iPhone13ProMax README.md Windows11Pro QuickBrownFox99 internationalisation hunter2 2024-01-15 README_v2.txt".split()
    assert list(secrets.find([f"key: {w}" for w in plain])) == []


def test_scores_against_brute_force():
    """The found credentials are those of a search without shortcuts: every part of a run, every format, all symbols."""
    automata = secrets.automata()

    def every(value, assigned, least):
        cuts = [i for i, c in enumerate(value) if c in "_+/.-"]
        out, done = [], 0
        for start in [0, *(c + 1 for c in cuts)]:
            found = []
            for stop in [*(c for c in cuts if c >= start + least), len(value)]:
                for kind, a in automata.items():
                    part = value[start:stop]
                    if start >= done and len(value) - start >= least and kind not in secrets.ASSIGNED_ONLY:
                        score = a.log_likelihood((secrets.ASSIGNED if assigned and not start else secrets.BARE) + part) - secrets.plain(part)
                        if score >= secrets.THRESHOLD:
                            found.append((score, stop, kind))
            if found:
                top = max(found)
                score, stop, kind = max((x for x in found if x[2] == top[2] and x[0] >= top[0] - secrets.LONGER), key=lambda x: x[1])
                out.append((start, stop, kind, score))
                done = stop
        if not out and assigned:
            found = []
            for kind in secrets.ASSIGNED_ONLY:
                base = secrets.named(value) if kind in secrets.NAMED else secrets.plain(value)
                score = automata[kind].log_likelihood(secrets.ASSIGNED + value) - base
                if score >= (secrets.NAMED_THRESHOLD if kind in secrets.NAMED else secrets.THRESHOLD):
                    found.append((score, kind))
            out = [(0, len(value), max(found)[1], max(found)[0])] if found else []
        return out

    values = [v for kind, vs in fresh(5).items() for v in vs[:6]]
    values += [f"{a}/{b}" for a, b in zip(values, reversed(values))] + ["some/long/path/to_a-file.tar", "AKIA", "internationalisation", "eyJ.eyJ.x"]
    for v in values:
        v = v.strip(".-+/")
        for assigned in (False, True):
            got = secrets.secrets_of(v, assigned)
            want = every(v, assigned, secrets.shortest(False))
            assert [g[:3] for g in got] == [w[:3] for w in want], (v, assigned)
            assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))


def test_without_merging_likelihood_is_frequency():
    """The sum over the unmerged tree: with a test that nothing different passes, a string's likelihood is its share of the labels."""
    import math
    from collections import Counter

    rng = random.Random(2)
    samples = ["".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(300)]
    a = secrets.Automaton(samples, alpha=2.0)  # the bound is 0
    counted = Counter(samples)
    for s, n in counted.items():
        assert abs(a.log_likelihood(s) - math.log(n / 300)) < 0.25, s
    assert abs(sum(math.exp(a.log_likelihood(s)) for s in counted) - 1) < 0.05
