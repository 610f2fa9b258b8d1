import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secrets


def plain(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "ApiKey", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "0123456789ABCDEF", "0123456789abcdef", "é", "K", "ſ", "\n"]), max_size=25))
def test_base_spans_are_the_patterns(parts):
    assert [x[:3] for x in secrets.base_spans("".join(parts))] == plain("".join(parts))


def test_held_out_findings():
    net = secrets.model()
    rows, y = secrets.labelled(800, 99)
    p = secrets.scores_of(net, [secrets.encode(*r) for r in rows]) >= net.threshold
    assert p[y].mean() > 0.95 and p[~y].mean() < 0.03


#: Written by hand, apart from the generator that trains the network: a random letter or digit for @, a small letter or digit for %, hexadecimal for #, a capital or digit for &.
SECRETS = [
    "use ghp_@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ to push", "slack xoxb-1234567890-1234567890123-@@@@@@@@@@@@@@@@@@@@@@@@ bot", "stripe sk_live_@@@@@@@@@@@@@@@@@@@@@@@@ charge", "maps key AIzaSy@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ here",
    "mail SG.@@@@@@@@@@@@@@@@@@@@@@.@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ sent", "npm_@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ for the registry", "jwt eyJhbGciOiJIUzI1NiJ9.eyJ@@@@@@@@@@@@@@@@@@@@@@@@.@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ ok",
    "Authorization: Bearer @@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@", "postgres://admin:@@@@@@@@@@@@@@@@@@@@@@@@/db1", "client_secret='@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@'", "AccountKey=@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@==;",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCY@@@@@@@@@@ is the one", "twilio SK################################ live", "heroku ########-####-####-####-############ auth", "telegram 123456789:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ bot",
    "glpat-@@@@@@@@@@@@@@@@@@@@ gitlab", "dop_v1_################################################################ ocean", "private MIIEpAIBAAKCAQEA@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ key", "see /srv/app/conf/tokens/@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@/read", "x-amz-signature=################################################################ end",
    "cookie: sid=%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "key &&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&& given", "pass: @@@@@@@@@@@@@@@@@@@@", "https://hooks.example.com/services/T0@@@@@@@/B0@@@@@@@/@@@@@@@@@@@@@@@@@@@@@@@@ posts",
]
PLAIN = [
    "see /usr/local/share/python/site-packages/numpy/core/multiarray.py line 3", "import org.apache.commons.collections4.iterators.ArrayListIterator", "the word Donaudampfschifffahrtsgesellschaft is long", "open https://www.example.com/articles/2024/05/how-to-bake-bread", "call getUserAccountBalanceById first",
    "set MAX_CONNECTION_RETRY_COUNT_PER_HOST to 5", "antidisestablishmentarianism is a word", "file holiday_pictures_summer_2023_final_v2.zip", "tag release-2024.05.06-hotfix-login-page", "==================== chapter one ====================", "the-quick-brown-fox-jumps-over-the-lazy-dog", "at 2024-05-06T12-30-45-summary", "class AbstractSingletonProxyFactoryBean here",
    "column customer_billing_address_line_2 missing", "run docker/library/postgres/alpine/entrypoint.sh", "a/b/testing/of/the/home/page/and/the/cart/page", "version python-3.13.0-embed-amd64.zip", "name=john&surname=smith&city=london&year=1990", "isbn 978-3-16-148410-0-paperback", "internationalization/localization/translation", "hahahahahahahahahahahaha", "README-installation-guide-linux.md", "order-number-00012345-berlin",
    "WARNING_LOW_DISK_SPACE_ON_VOLUME", "user/profile/settings/notifications/email", "--no-interaction-with-the-user", "Llanfairpwllgwyngyllgogerychwyrndrobwll", "en.wikipedia.org/wiki/Natural_language_processing", "thisisaverylonghashtagwithoutspaces", "src/main/java/com/company/project/Application.java",
]


def filled(text, rng):
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = {"@": small + small.upper() + digits, "%": small + digits, "#": digits + "abcdef", "&": small.upper() + digits}
    return "".join(rng.choice(sets[c]) if c in sets else c for c in text)


def test_formats_written_by_hand():
    net, rng = secrets.model(), random.Random(4)
    good, bad = [filled(t, rng) for t in SECRETS for _ in range(5)], PLAIN
    hit = [bool(f) for f in secrets.findings(good, net)]
    wrong = [bool(f) for f in secrets.findings(bad, net)]
    recall, precision = sum(hit) / len(hit), sum(hit) / (sum(hit) + 5 * sum(wrong))
    print("recall", recall, "precision", precision, sorted({t[:40] for t, h in zip(good, hit) if not h}), [t for t, w in zip(bad, wrong) if w])
    assert recall >= 0.9 and precision >= 0.9


def test_batches_are_the_plain_network():
    net, rng = secrets.model(), random.Random(9)

    def plain(row):
        z = np.maximum(net.shift + np.array([sum(net.kernel[k][row[i + k]] for k in range(secrets.SPAN)) for i in range(len(row) - secrets.SPAN + 1)]), 0)
        smooth = np.array([z[i : i + secrets.SMOOTH].sum(axis=0) / secrets.SMOOTH for i in range(len(z))])
        return np.maximum(smooth @ net.inner + net.inner_shift, 0).max(axis=0) @ net.out + net.bias

    rows = [np.array([rng.randrange(2 * secrets.CODES) for _ in range(n)]) for n in (36, 50, 400, 40, 90)]
    assert np.allclose(secrets.forward(net, rows)[0], [plain(r) for r in rows])
    assert np.allclose([secrets.forward(net, [r])[0][0] for r in rows], [plain(r) for r in rows])


def test_long_candidates_are_read_whole(monkeypatch):
    net = secrets.model()
    way = "the/on/an/re/le/de/" * 40
    for middle, secret in (("entiondetheentiondetheention", False), ("xK9dPq27LmZt40RsVbYh8Wc3JtQ5", True)):
        for text in (f"see {way}{middle}/{way}4 end", f"see {middle}/{way}4 end", f"see {way}4{middle} end"):
            assert len(secrets.candidates(text)) == 1
            assert bool(secrets.findings([text], net)[0]) == secret
    row = secrets.encode(text, *secrets.candidates(text)[0])
    whole = secrets.scores_of(net, [row])
    for block in (7, 16, 100):
        monkeypatch.setattr(secrets, "BLOCK", block)
        assert np.allclose(secrets.scores_of(net, [row]), whole)


def test_base_findings_are_scored_and_cover_candidates():
    net = secrets.model()
    (found,) = secrets.findings(['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'], net)
    assert [f["kind"] for f in found] == ["assign", "hex"] and all(f["score"] > 0.9 for f in found)
    (found,) = secrets.findings(["key 0123456789abcdef01234567XyZw9QpLk2 end"], net)
    assert [(f["kind"], f["start"]) for f in found] == [("hex", 4), ("token", 4)] and found[1]["end"] > found[0]["end"]


def test_rows(spark):
    clean = "ordinary words that say nothing at all, thtionerandthenthing 2024-01-02 and 12345678901234567890"
    leak = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and Bearer xK9dPq27LmZt40RsVbYh8Wc3'
    df = spark.createDataFrame([(1, clean, 0), (2, leak, 0), (3, None, 0), (4, "", 0), (2, leak, 0)], "doc_id long, text string, findings int")
    out = {r.doc_id: r for r in secrets.secret_digests(df).collect()}
    assert secrets.secret_digests(df).count() == 5 and secrets.secret_digests(df.limit(0)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert out[1].spans == out[3].spans == out[4].spans == "" and out[3].base_sha256 == empty
    assert (out[2].n_assign, out[2].n_access, out[2].n_hex) == (1, 0, 1)
    base = f"assign:2:{leak.index('ff') + 2},hex:11:51"
    assert out[2].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert out[2].spans.startswith(base) and "token:" in out[2].spans
