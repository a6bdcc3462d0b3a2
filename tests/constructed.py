"""Texts put together from labelled parts, so that their indicators are known without searching for them."""

import random

# (as written, type, value); None: nothing is found in it. Values were worked out by hand.
PARTS = [
    ("malware.example.com", "domain", "malware.example.com"), ("drop[.]zone[.]org", "domain", "drop.zone.org"), ("cdn(.)hosted(.)net", "domain", "cdn.hosted.net"),
    ("archive.zip", "domain", "archive.zip"), ("payload.exe", "file", "payload.exe"), ("notes.docx", "file", "notes.docx"), ("notes.xyzzy", None, None), ("plainword", None, None),
    ("203.0.114.9", "ipv4", "203.0.114.9"), ("198[.]20[.]30[.]40", "ipv4", "198.20.30.40"), ("9 8 7 6", "ipv4", "9.8.7.6"), ("192.168.4.4", None, None),
    ("127.0.0.1", None, None), ("224.1.2.3", "ipv4", "224.1.2.3"), ("300.1.1.1", None, None), ("someone@mail.example.org", "email", "someone@mail.example.org"),
    ("some.one[@]mail.example[.]org", "email", "some.one@mail.example.org"), ("https://path.example.com/a/b?c=1", "url", "https://path.example.com/a/b?c=1"),
    ("hxxp://far[.]example[.]net/x", "url", "http://far.example.net/x"), ("google.com", None, None), ("https://google.com/search", None, None),
    ("CVE-2023-4567", "cve", "CVE-2023-4567"), ("cve-2021-99999", "cve", "cve-2021-99999"), ("CVE-2020-0000", None, None),
    ("ab" * 16, "md5", "ab" * 16), ("C0" * 20, "sha1", "C0" * 20), ("7e" * 32, "sha256", "7e" * 32), ("ab" * 17, None, None),
    ("APT28", "apt_group_mention", "APT28"), ("fancy BEAR", "apt_group_mention", "fancy BEAR"), ("lazarus group", "apt_group_mention", "lazarus group"),
    ("North Korea", "country_mention", "North Korea"), ("korea", "country_mention", "korea"), ("Koreans", None, None),
]
#: Words that stand between parts; none of them is anything, and they end what is before.
FILLER = ["then", "we", "saw", "it", "twice", "again", "near", "old", "tables", "(see", "\"quoted\"", "end);", "é", "😀"]
HARMLESS = "for example"


def build(rng, n):
    """A normalised text and its hits: (start, end, type, value)."""
    text, hits = rng.choice(FILLER), []
    for _ in range(n):
        raw, kind, value = rng.choice(PARTS)
        text += " " + " ".join(rng.choice(FILLER) for _ in range(rng.randint(1, 9))) + " , "
        if kind:
            hits.append((len(text), len(text) + len(raw), kind, value))
        text += raw + " , " + rng.choice(FILLER)
    return text, hits


def dirty(rng, text):
    """The same text before normalisation."""
    out = "".join(rng.choice([" ", "  ", "\n", "\u00a0", "\t \n"]) if c == " " else rng.choice('"“”') if c == '"' else c for c in text)
    return rng.choice(["", " ", "\n"]) + out + rng.choice(["", " "])


def snippet(text, start, end):
    return f"...{text[max(0, start - 50):end + 50]}..."


def random_built(n, seed, most=12):
    rng = random.Random(seed)
    return [build(rng, rng.randrange(most)) for _ in range(n)], rng
