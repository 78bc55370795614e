"""Secrets on later lines and key blocks; the scorer against all candidates found without its one pass."""

import random
import re
import string

import pytest

from corpusmill.llm import secret_novelty as S

LETTERS = string.ascii_letters + string.digits


def random_key(rng, n, letters=LETTERS):
    return "".join(rng.choices(letters, k=n))


@pytest.mark.parametrize("lines", [3, 10, 50])
@pytest.mark.parametrize("kind", ["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"])
@pytest.mark.parametrize("end", ["\n", "\\n", '\\n"\n + "'])
def test_key_blocks_are_one_span(lines, kind, end):
    rng = random.Random(lines)
    body = end.join(random_key(rng, 64, LETTERS + "+/") for _ in range(lines))
    text = f"config = load()\n-----BEGIN {kind}-----{end}{body}{end}-----END {kind}-----\nrun(config)"
    start = text.index(body)
    assert [s for s in S.spans(text) if s[0] == "novel"] == [("novel", start, start + len(body))]


@pytest.mark.parametrize("form", ['{{"private_key":\n  "{}"}}', "signing_key = (\n    '{}'\n)", "client_secret: >\n  {}\n", "session_cookie =\n\t{}", 'webhook_url_secret := \\\n  "{}"', 'encryption_keys = [\n  "{}"]'])
def test_values_on_the_next_line(form):
    rng, found = random.Random(7), 0
    for _ in range(50):
        key = random_key(rng, 32)
        text = form.format(key)
        at = text.index(key)
        found += any(a <= at and b >= at + 32 for _, a, b in S.spans(text))
    assert found == 50


def test_other_text_on_the_next_line_is_not_reported():
    names = ["\nuser_authentication_handler_configuration = 3", " = (\n    default_connection_timeout_seconds\n)", ":\n  description_of_the_parameter", "\n\nThe following paragraph explains nothing.", ":\n" + "abcd1234" * 8]
    assert not [s for n in names for s in S.spans("private_key" + n) if s[0] == "novel"]
    assert S.spans("-----BEGIN PRIVATE KEY-----\n") == S.spans("-----BEGIN PRIVATE KEY-----\n" + "-----END PRIVATE KEY-----") == []
    public = "-----BEGIN CERTIFICATE-----\n" + "\n".join(random_key(random.Random(i), 64) for i in range(5))
    assert S.spans(public) == []


def test_scorer_over_all_substrings_of_a_text():
    """Every maximal run of key characters, each measured for itself, gives the rows the one pass gives."""
    rng, lines = random.Random(11), []
    for n in range(200):
        value = random_key(rng, rng.randrange(12, 90)) if n % 2 else rng.choice(["default_connection_timeout", "path/to/the/configuration/file", "x"])
        lines.append(rng.choice(["auth {}", "value = {}", "bearer\n{}", "the credential\nis {}", "private_key:\n '{}'"]).format(value))
    text = "\n".join(lines)
    words = [(m.start(), m.end()) for m in S.CONTEXT.finditer(text)]
    expected = []
    for a in range(len(text)):
        m = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}").match(text, a)
        before = [w for w in words if w[1] <= a]
        if not m or not before:
            continue
        between = text[before[-1][1] : a]
        near = len(between) < 48 and "\n" not in between
        later = re.fullmatch(r"[\"']?\s*[:=]?\s*[\"']?", between)
        if (near or later) and any(c.isalpha() for c in m[0]) and S.novelty(text, a, m.end()) >= 0.8 and S.spelled(m[0]) < 1.0:
            expected.append(("novel", a, m.end()))
    base = {s[1:] for s in S.spans(text) if s[0] != "novel"}
    got = [s for s in S.spans(text) if s[0] == "novel"]
    assert len(got) > 40 and got == [s for s in expected if s[1:] not in base]
