"""What a chat message says: the pages it names, claims and failure reports, directives and questions, flags.

All rules read one text.  What depends on other records (whether a message corrects an earlier claim, repeats one, or rests on the
speaker's own check) is joined later, by ``operators.adaptation``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases that claim something done.
CLAIM_PHRASES = (
    r"is (?:now )?live", r"are (?:now )?live", "now live", "went live", "deployed", "published", "is up at", "are up at", "shipped", "launched", "fixed", r"is working(?! on)", r"are working(?! on)", "verified",
)
#: Words that report a failure.
FAILURE_WORDS = (
    "404", "not found", "broken", r"fail(?:ed|ing|s|ure)?", "errors?", "is down", "are down", r"isn['’]?t live", r"not (?:yet )?live", r"still (?:returning|showing)", "unreachable",
)
#: Words of what is yet to come, and hedges.
FUTURE_WORDS = (r"will (?:be|go)", r"once\b", r"soon\b", "going to", "planning", "plan to", "about to", r"when (?:it|this) (?:is|goes)")
HEDGES = ("may take", "should be", "i think", "probably", "pending")
#: Words of the claims that name no page.
TESTS_PASS = (
    r"all (?:\d+ )?tests? (?:are )?pass(?:ing|ed)?", r"tests? (?:are |now )*(?:pass(?:ing|ed)?|green)", r"test suite pass(?:es|ed)", r"\d+(?:/\d+)? tests? pass(?:ing|ed)?",
)
FIXED, PUSHED, MADE = ("fixed", "resolved", "patched"), ("deployed", "pushed", "merged"), ("created", "wrote", "saved", "added")
#: Words that blame the surroundings, and that own an error.
BLAME = ("bug", "broken", "not working", "site is down", "is down", "server is down")
OWN_ERROR = (r"my (?:mistake|error|bad|fault)", r"i (?:made a|introduced|forgot|mistyped|broke)", "typo", "i was wrong", "my typo")
#: Words that take a claim back.
CORRECTION = (
    "correction", "i was wrong", "i misspoke", "my mistake", "that was incorrect", r"retract(?:ing)?", r"is (?:actually )?(?:down|broken|still 404|returning 404)", r"not (?:actually )?live",
)
#: Polite requests, and words that open an order.
POLITE, ORDERS = ("can you", "could you", "would you", "please"), ("check", "run", "deploy", "fix", "review", "test", "update", "post", "add", "merge", "verify")
#: Words that are no content of a directive.
EMPTY_WORDS = frozenset(
    """the and for with that this from your you are was were have has will can could would should please into onto about just also then than them they
    their there here what when where which while been being make sure take over care look""".split()
)
#: Hosts whose pages are code, not sites.
CODE_HOSTS = ("github.com", "gitlab.com", "www.github.com")
#: Words that make the address after them a link's target; words of a claim on several pages.
LINK_WORDS = ("points to", "links to", "redirects to", "pointing at", "linking to")
SEVERAL = (r"products", "pages", "chapters", "links", "sites", "both", r"all \d+")


def _any(words: tuple[str, ...], flags: int = re.I) -> re.Pattern[str]:
    return re.compile(r"\b(?:" + "|".join(words) + r")\b", flags)


_CLAIM, _FAILED, _FUTURE, _HEDGE = _any(CLAIM_PHRASES), _any(FAILURE_WORDS), _any(FUTURE_WORDS), _any(HEDGES)
_TESTS, _FIXED, _PUSHED, _MADE, _BLAME, _OWN = _any(TESTS_PASS), _any(FIXED), _any(PUSHED), _any(MADE), _any(BLAME), _any(OWN_ERROR)
_CORRECTS, _POLITE, _ORDER = _any(CORRECTION), _any(POLITE), re.compile(r"(?:" + "|".join(ORDERS) + r")\b", re.I)
_URL = re.compile(r"https?://[^\s'\"<>)\]`*,]+")
_TARGET = re.compile(r"(?:" + "|".join(LINK_WORDS) + r")\s*[(\"'`<]?\s*$", re.I)
_ARROW = re.compile(r"https?://\S+\s*(?:→|->)\s*[(\"'`<]?\s*$")
_PLURAL = re.compile(r"\b(?:" + "|".join(SEVERAL) + r")\b.{0,60}?\b(?:live|published|deployed)\b", re.I)
_COLON = re.compile(_CLAIM.pattern + r"[^.!?:]{0,40}:(?=\s)", re.I)
_TAG = re.compile(r"(?:^|\s)(#[A-Za-z][\w-]{2,30})\b|(\[[A-Z][A-Z0-9 _-]{1,15}\])")
_ISSUE = re.compile(r"(?:^|\s)#(\d{1,6})\b")
_PATH = re.compile(r"(?:^|[\s\"'`(=:])((?:~?/|\.\.?/)?(?:[\w.-]+/)+[\w.-]+\.[a-z0-9]{1,6})(?=$|[\s\"'`),;:]|\.(?:\s|$))", re.I)
_PASSED = re.compile(r"\b(\d{1,6})(?:/\d+)?\s+(?:tests?\s+|specs?\s+)?pass(?:ed|ing|es)?\b", re.I)
_STATUS = (re.compile(r"\b([1-5]\d\d) OK\b"), re.compile(r"\bHTTP/?[\d.]*\s+([1-5]\d\d)\b"))


def page(url: str) -> str:
    """https, the host in lower case, no query, fragment, closing slash or closing punctuation."""
    bare = url.rstrip(".:;!?")
    m = re.match(r"https?://([^/?#]+)([^?#]*)", bare)
    return f"https://{m[1].lower()}{m[2].rstrip('/')}" if m else bare


def _whole(url: str) -> bool:
    """Whether an address is meant as it stands, not as a template."""
    return not re.search(r"[{}\[\]$<>*\\]", url) and bool(re.match(r"https?://[a-z0-9.-]+\.[a-z]{2,}", url, re.I))


def pages(text: str) -> list[str]:
    return list(dict.fromkeys(page(u) for u in _URL.findall(text) if _whole(u)))


def is_site(url: str) -> bool:
    return url.removeprefix("https://").split("/", 1)[0] not in CODE_HOSTS


def refs(text: str, most: int = 20) -> list[str]:
    """Pages and file paths that a text names, at most ``most``."""
    found = dict.fromkeys(pages(text))
    for m in _PATH.finditer(text):
        if len(found) >= most:
            break
        if len(m[1]) <= 200 and "//" not in m[1]:
            found[m[1].removeprefix("./")] = None
    return list(found)[:most]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"\n+|(?<=[.!?])\s+", text) if s.strip()]


def _claims(sentence: str) -> bool:
    return bool(_CLAIM.search(sentence)) and not _FUTURE.search(sentence) and not _FAILED.search(sentence)


def _subjects(sentence: str) -> list[str]:
    """The pages that a claiming sentence claims: no link targets; of several pages the nearest to each phrase, unless the
    sentence claims them all."""
    found = []
    for m in _URL.finditer(sentence):
        before = sentence[max(0, m.start() - 400) : m.start()]
        if _whole(m[0]) and not _TARGET.search(before[-40:]) and not _ARROW.search(before):
            found.append((m.start(), m.end(), page(m[0])))
    if len(found) <= 1 or _PLURAL.search(sentence) or _COLON.search(sentence):
        return list(dict.fromkeys(u for *_, u in found))
    gap = lambda a, b, p: p.start() - b if b <= p.start() else max(0, a - p.end())
    return list(dict.fromkeys(min(found, key=lambda f: gap(f[0], f[1], p))[2] for p in _CLAIM.finditer(sentence)))


def claimed_pages(text: str, of: list[str]) -> list[tuple[str, str]]:
    """(page, rule): those of a claiming sentence; or the only page of a message, bare in its last sentence, after a claim."""
    parts = sentences(text)
    direct = {u for s in parts if _claims(s) for u in _subjects(s)}
    end = parts[-1] if parts else ""
    bare = re.sub(r"@\S+", " ", re.sub(r"https?://\S+", " ", end))
    few = sum(bool(re.search("[a-z0-9]", w, re.I)) for w in bare.split()) <= 4
    headline = any(_claims(s) and not pages(s) for s in parts[:-1])
    out = []
    for u in of:
        if u in direct:
            out.append((u, "claim-sentence"))
        elif few and headline and pages(text) == [u] and u in pages(end):
            out.append((u, "claim-bare-url"))
    return out


def failed_page(text: str, of: list[str]) -> str | None:
    """The first page named in a sentence that reports a failure, neither hedged nor yet to come."""
    for s in sentences(text):
        if _FAILED.search(s) and not (_HEDGE.search(s) or _FUTURE.search(s) or re.search(r"\bcan take\b", s, re.I)):
            hit = next((u for u in pages(s) if u in of), None)
            if hit:
                return hit
    return None


def stated_number(text: str) -> tuple[float, str] | None:
    """A number beside a word for passing, and its kind."""
    if m := _PASSED.search(text):
        return float(m[1]), "tests-passed"
    m = _STATUS[0].search(text) or _STATUS[1].search(text)
    return (float(m[1]), "http-status") if m else None


def content_words(text: str) -> list[str]:
    plain = re.sub(r"@\S+", " ", re.sub(r"https?://\S+", " ", text.lower()))
    return list(dict.fromkeys(w for w in re.split(r"[^a-z0-9]+", plain) if len(w) >= 4 and w not in EMPTY_WORDS))[:30]


def _dashes(text: str) -> str:
    return re.sub("[‐-―−]", "-", text)


def addressed(text: str, roster: dict[str, str], speaker: str | None) -> tuple[list[str], list[str], list[str]]:
    """(named, ordered, asked): agents that a text names, gives an order to and asks; more than two mentions are a broadcast, neither
    order nor question.  ``roster`` is name by id."""
    flat = _dashes(text)
    others = {a: _dashes(n) for a, n in roster.items() if a != speaker and len(n) >= 2}
    named = [a for a, n in others.items() if f"@{n}" in flat or (len(n) >= 6 and re.search(rf"(?:^|[^\w-]){re.escape(n)}(?![\w-])", flat))]
    if sum(f"@{n}" in flat for n in others.values()) > 2:
        return named, [], []
    ordered, asked = {}, {}
    for s in sentences(flat):
        to = [a for a, n in others.items() if f"@{n}" in s]
        rest = s
        for a in to:
            rest = rest.replace(f"@{others[a]}", " ")
        if _POLITE.search(s) or _ORDER.match(rest.lstrip(" \t,;:!.—–-")):
            ordered |= dict.fromkeys(to)
        if "?" in s:
            asked |= dict.fromkeys(to)
    return named, list(ordered), list(asked)


def reading(text: str | None, roster: dict[str, str], speaker: str | None) -> dict:
    """All that a message says by itself.  ``intent`` is the first of the rules that fits: claim, quote, tests, fixed, pushed, made,
    directive or message; ``corrects`` tells that it would be a correction of an earlier claim on one of its pages."""
    text = (text or "").strip()
    urls = pages(text)
    sites = [u for u in urls if is_site(u)]
    found = refs(text)
    paths = [r for r in found if not r.lower().startswith("http")]
    issue = _ISSUE.search(text)
    number = stated_number(text)
    named, ordered, asked = addressed(text, roster, speaker) if speaker else ([], [], [])
    failing = bool(_FAILED.search(text))
    claimed = claimed_pages(text, sites) if 1 <= len(sites) <= 2 and not failing else []
    broken = failed_page(text, sites) if speaker is None or len(sites) <= 2 else None
    plain = not urls and not failing and not _FUTURE.search(text)
    file = f"file:{paths[0]}" if paths else None
    change = f"pr:#{issue[1]}" if issue else None
    if speaker and claimed:
        intent, artifact, version = "claim", None, None
    elif broken:
        intent, artifact, version = "quote", broken, "live"
    elif speaker and plain and _TESTS.search(text):
        intent, artifact, version = "tests", None, None
    elif speaker and plain and _FIXED.search(text) and (file or change):
        intent, artifact, version = "fixed", file or change, "exists" if file else "merged"
    elif speaker and plain and _PUSHED.search(text):
        merged = change if re.search(r"\bmerged\b", text, re.I) else None
        intent, artifact, version = "pushed", merged, "merged" if merged else None
    elif speaker and plain and _MADE.search(text) and file:
        intent, artifact, version = "made", file, "exists"
    elif speaker and ordered:
        intent, artifact, version = "directive", None, None
    else:
        intent, artifact, version = "message", None, None
    return {
        "intent": intent, "artifact": artifact, "version": version, "claimed": [{"page": u, "rule": r} for u, r in claimed], "pages": urls, "names": sites[:10], "refs": found,
        "corrects": bool(_CORRECTS.search(text)), "hedged": bool(_HEDGE.search(text)), "number_value": number[0] if number else None, "number_kind": number[1] if number else None,
        "is_question": text.endswith("?"), "negative": failing, "blame": bool(_BLAME.search(text)), "own_error": bool(_OWN.search(text)),
        "conventions": list(dict.fromkeys(a or b for a, b in _TAG.findall(text)))[:10], "named": named, "ordered": ordered, "asked": asked, "tokens": content_words(text),
    }


READING = """struct<intent: string, artifact: string, version: string, claimed: array<struct<page: string, rule: string>>, pages: array<string>, names: array<string>, refs: array<string>,
    corrects: boolean, hedged: boolean, number_value: double, number_kind: string, is_question: boolean, negative: boolean, blame: boolean, own_error: boolean,
    conventions: array<string>, named: array<string>, ordered: array<string>, asked: array<string>, tokens: array<string>>"""
_ARROW_READING = pa.struct(
    [("intent", pa.string()), ("artifact", pa.string()), ("version", pa.string()), ("claimed", pa.list_(pa.struct([("page", pa.string()), ("rule", pa.string())]))), *[(n, pa.list_(pa.string())) for n in ("pages", "names", "refs")],
     ("corrects", pa.bool_()), ("hedged", pa.bool_()), ("number_value", pa.float64()), ("number_kind", pa.string()), *[(n, pa.bool_()) for n in ("is_question", "negative", "blame", "own_error")],
     *[(n, pa.list_(pa.string())) for n in ("conventions", "named", "ordered", "asked", "tokens")]]
)


def readings(messages: DataFrame, roster: dict[str, str], text: str = "content", speaker: str = "speaker") -> DataFrame:
    """``messages`` with ``said``, the reading of each; ``speaker`` is null where a person speaks.  The (small) roster goes to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [reading(t, roster, s) for t, s in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index(speaker)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, _ARROW_READING)], names=[*b.schema.names, "said"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInArrow(run, f"{fields}, said {READING}")
