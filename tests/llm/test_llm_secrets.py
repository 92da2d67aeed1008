import hashlib
import random
import re
import string
from collections import Counter

from llm_data import awkward_rows, clashing, docs

from fraudlens.llm import secret_scan as S


def random_key(rng, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_base_patterns():
    text = ("Password: 'abcdefghijkl' token=short api-key=abcdefghijklmn APIKEY = \"Abc/def+ghi=123\" "
            "AKIAABCDEFGHIJ1234 AKIA123 0123456789abcdef deadbeef ſecret=abcdefghijklmnop")
    found = S.base_spans(text)
    assert [text[a:b] for k, a, b in found if k == "assign"] == [
        "Password: 'abcdefghijkl", 'APIKEY = "Abc/def+ghi=123']
    assert [text[a:b] for k, a, b in found if k == "access"] == ["AKIAABCDEFGHIJ1234"]
    assert [text[a:b] for k, a, b in found if k == "hex"] == ["0123456789abcdef"]


def test_a_failing_match_still_uses_up_its_text():
    # the value of the first match holds the second name
    assert S.base_spans("token=secret=abc def") == []
    (only,) = S.base_spans("token=secret=abcdefghijkl")
    assert only == ("assign", 0, 25)


def test_novelty_reports_keys_and_spares_names():
    rng = random.Random(4)
    novelty = S.Novelty()
    for _ in range(50):
        key = random_key(rng, 32)
        text = f"the client credential for the service is {key} and should stay private"
        spans = S.scan_text(text, novelty)
        assert ("novel", text.index(key), text.index(key) + 32) in spans, key
    for name in ("default_configuration_value", "application/json/response1", "localhost:5432/database1/username",
                 "abcabcabcabcabc123123123123", "AuthenticationServiceFactory"):
        text = f"the client credential for {name} in {name}"
        assert not [s for s in S.scan_text(text, novelty) if s[0] == "novel"], name
    plain = f"an order number {random_key(rng, 32)} without such a context"
    assert S.scan_text(plain, novelty) == []


def test_long_keys_and_small_alphabets_are_found():
    rng = random.Random(12)
    novelty = S.Novelty()
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    alphabets = {"base64": upper + lower + string.digits + "+/", "base64url": upper + lower + string.digits + "-_",
                 "base32": upper + "234567", "HEX": "0123456789ABCDEF", "hex": "0123456789abcdef",
                 "letters": upper + lower, "lower": lower, "upper": upper}
    for name, alphabet in alphabets.items():
        for n in (64, 128, 172, 200, 512, 2000):
            for _ in range(10):
                key = random_key(rng, n, alphabet)
                if name != "hex" and S.base_spans(key):  # by chance, as AKIA...: reported as such, with the rest beside it
                    continue
                text = f"the private key of this service is {key} and should stay private"
                at = text.index(key)
                assert (("hex" if name == "hex" else "novel"), at, at + n) in S.scan_text(text, novelty), (name, key)
    head, tail = (random_key(rng, 100, alphabets["base64"]) for _ in range(2))
    text = f"the private key is {head}0123456789abcdef{tail}"
    a = text.index(head)
    for x in (("novel", a, a + 100), ("hex", a + 100, a + 116), ("novel", a + 116, a + 216)):
        assert x in S.scan_text(text, novelty)
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + ".".join(random_key(rng, n, alphabets["base64url"]) for n in (300, 43))
    assert S.scan_text(f"Authorization: Bearer {jwt}", novelty) == [("novel", 22, 22 + len(jwt))]


def test_words_without_digits_and_repetitions_are_spared():
    novelty = S.Novelty()
    for name in ("internationalization", "AuthenticationServiceFactory", "get_authentication_token_for_current_user_session",
                 "usr/local/lib/python3.11/site-packages/requests/adapters/http_client", "X" * 300, "=" * 80, "ABCDEF01" * 40,
                 "com.example.project.security.oauth2.config.ResourceServerConfiguration", "abcdefghijklmnopqrstuvwxyz"):
        assert not [s for s in S.scan_text(f"the client credential for {name} is kept", novelty) if s[0] == "novel"], name


def test_report(spark):
    rng = random.Random(9)
    key = random_key(rng, 40)
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "é 😀 secret: abcdefghijklmnop", None, None, None),
            (4, f"bearer {key}", None, None, None), (5, "word " * 200_000 + "token=abcdefghijklmnop", None, None, None)]
    got = {r.doc_id: r for r in S.report(clashing(docs(spark, rows * 2))).collect()}
    assert got[1].spans == got[2].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "assign:4:28" and got[3].n_assign == 1
    assert got[3].base_sha256 == hashlib.sha256(b"assign:4:28").hexdigest()
    assert got[4].spans == "novel:7:47" and got[4].n_novel == 1 and got[4].base_sha256 == got[1].base_sha256
    assert got[5].spans == "assign:1000000:1000022"
    assert S.report(docs(spark, rows * 2)).count() == 10
    assert S.report(docs(spark, [])).collect() == []


def plain_pairs(texts):
    out = Counter()
    for t in texts:
        for run in re.findall("[a-z]+", (t or "").replace("\u212a", "?").replace("\u0130", "?").lower()):
            out.update(run[i:i + 2] for i in range(len(run) - 1) if len(run) < S.CANDIDATE_LEN)
    return [out[a + b] for a in string.ascii_lowercase for b in string.ascii_lowercase]


def test_letter_pairs_are_counted_over_all_texts(spark):
    rows = awkward_rows() + [(900, "ab" * 7 + " " + "ab" * 8 + " a b aB-cd\u212aef", None, None, None)]
    want = plain_pairs(r[1] for r in rows)
    assert S.corpus_pairs(clashing(docs(spark, rows)).repartition(3)) == want and sum(want) > 1000
    assert S.corpus_pairs(docs(spark, [])) == [0] * 676
    assert S.pair_bits(S.IDENTIFIERS, [0] * 676) == S.pair_bits(S.IDENTIFIERS)


def test_the_corpus_tells_what_words_are(spark):
    rng = random.Random(8)
    # words of a language that the identifiers do not resemble
    syllables = ["szcz", "wyk", "prz", "ywo", "kla", "dzie", "trzy", "mow", "bry", "jak", "ych", "zeg"]

    def word(n):
        return "".join(rng.choice(syllables) for _ in range(n))
    corpus = [" ".join(word(rng.randint(1, 4))[:12] for _ in range(200)) for _ in range(40)]
    learned, bare = S.Novelty(corpus=plain_pairs(corpus)), S.Novelty()
    seen = Counter()
    for _ in range(200):
        for name, own in (("words", word(8)), ("key", random_key(rng, 32, string.ascii_lowercase))):
            text = f"the client credential for {own} is kept"
            for model, novelty in (("learned", learned), ("bare", bare)):
                seen[name, model] += any(s[0] == "novel" for s in S.scan_text(text, novelty))
    assert seen["words", "learned"] <= 2 < 50 < seen["words", "bare"], seen
    assert seen["key", "learned"] >= 194, seen


def test_report_equals_a_scan_of_each_text(spark):
    rng = random.Random(10)
    rows = awkward_rows() + [(700 + i, f"the secret of {i}: {random_key(rng, 10 + i)} or {'unbelievable' * (i % 3)} ",
                              None, None, None) for i in range(30)]
    novelty = S.Novelty(corpus=plain_pairs(r[1] for r in rows))
    want = Counter((r[0], ",".join(f"{k}:{a}:{b}" for k, a, b in S.scan_text(r[1], novelty))) for r in rows)
    got = S.report(clashing(docs(spark, rows)).repartition(4)).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == want
    assert sum(r.n_novel for r in got) > 20
