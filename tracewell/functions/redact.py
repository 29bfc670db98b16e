"""Redaction: rules that find personal data and secrets, in a fixed order, each with its placeholder.

Every rule has needles, short strings one of which must be present before its pattern
runs, so most texts cost a few substring searches.  Patterns are linear: bounded runs, no nested
repetition.  Redacting a redacted text changes nothing.
"""

from __future__ import annotations

import ipaddress
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Placeholders.
CREDENTIAL, EMAIL, PHONE, IP, URL_CREDENTIAL = "[credential]", "[email]", "[phone]", "[ip]", "[url-credential]"
#: Name parts whose values are secrets.
PASSWORD_NAMES = ("password", "passwd", "pwd", "passphrase")
SECRET_NAMES = ("secret", "token", "apikey", "api_key", "access_key", "private_key", "client_secret", "auth_token", "credentials")
#: Prefixes of cloud key ids, which need no digit.
KEY_IDS = ("A3T", "AKIA", "ASIA", "ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "ANPA", "ANVA", "AROA", "APKA")
#: Formats of providers' keys.
PROVIDER_KEYS = (
    r"(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA|AGPA|AIDA|AIPA|ANPA|ANVA|AROA|APKA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,251}",
    r"github_pat_[A-Za-z0-9_]{22,251}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abposr]-[A-Za-z0-9-]{10,}",
    r"xapp-[0-9]-[A-Za-z0-9-]{10,}",
    r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"hf_[A-Za-z0-9]{30,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_-]{50,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"(?:AC|SK)[0-9a-f]{32}",
)


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _tokenish(value: str, least: int) -> bool:
    return len(value) >= least and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


@dataclass(frozen=True)
class Rule:
    """``replace`` returns what a match becomes, or None to leave it."""

    name: str
    pattern: re.Pattern[str]
    replace: Callable[[re.Match[str]], str | None]
    needles: tuple[str, ...]

    def apply(self, text: str, lowered: str) -> tuple[str, int]:
        if not any(n in lowered for n in self.needles):
            return text, 0
        hits = 0

        def sub(m: re.Match[str]) -> str:
            nonlocal hits
            new = self.replace(m)
            if new is None or new == m[0]:
                return m[0]
            hits += 1
            return new

        return self.pattern.sub(sub, text), hits


def _url(m: re.Match[str]) -> str | None:
    user = m[2]
    return f"{m[1]}{URL_CREDENTIAL}@" if user != URL_CREDENTIAL and (":" in user or _tokenish(user, 16)) else None


def _provider(m: re.Match[str]) -> str | None:
    return CREDENTIAL if any(c.isdigit() for c in m[0]) or m[0].startswith(KEY_IDS) else None


def _auth(m: re.Match[str]) -> str | None:
    value = m[2]
    bearer = m[1].lower().rstrip().endswith("bearer")
    good = _tokenish(value, 12) if bearer else len(value) >= 8
    return f"{m[1]}{CREDENTIAL}" if good and not value.startswith("[") else None


def _keyword(m: re.Match[str]) -> str | None:
    name, value = m[1].lower().replace("-", "_"), m[3]
    if value.startswith("["):
        return None
    if any(name.endswith(p) for p in PASSWORD_NAMES):
        classes = sum((any(map(str.islower, value)), any(map(str.isupper, value)), any(map(str.isdigit, value)), any(not c.isalnum() for c in value)))
        good = len(value) >= 12 or (len(value) >= 6 and (any(map(str.isdigit, value)) or classes >= 3))
    else:
        good = len(value) >= 16 and entropy(value) >= 3.0
    return f"{m[1]}{m[2]}{CREDENTIAL}" if good else None


def _email(allowed: tuple[str, ...]) -> Callable[[re.Match[str]], str | None]:
    def sub(m: re.Match[str]) -> str | None:
        user, _, domain = m[0].lower().rpartition("@")
        keep = user in ("git", "hg", "svn") or any(domain == a or domain.endswith("." + a) for a in allowed)
        return None if keep else EMAIL

    return sub


def _ip(m: re.Match[str]) -> str | None:
    try:
        a = ipaddress.ip_address(m[0])
    except ValueError:
        return None
    return IP if a.is_private or a.is_loopback or a.is_link_local else None


def rules(allowed_domains: tuple[str, ...] = (), with_ip: bool = False) -> tuple[Rule, ...]:
    """The rules in order; addresses are left alone unless asked for."""
    fixed = lambda to: lambda m: to
    names = "|".join((*PASSWORD_NAMES, *SECRET_NAMES)).replace("_", "[_-]?")
    out = [
        Rule("url_credential", re.compile(r"\b([A-Za-z][A-Za-z0-9+.-]{1,20}://)([^\s/@?#]{1,256})@"), _url, ("://",)),
        Rule("private_key", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]{0,20000}(?:-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----)?"), fixed(CREDENTIAL), ("private key",)),
        Rule("provider_key", re.compile(r"(?<![A-Za-z0-9_-])(?:" + "|".join(PROVIDER_KEYS) + r")(?![A-Za-z0-9_-])"), _provider,
             (*(k.lower() for k in KEY_IDS), "gh", "glpat", "xox", "xapp", "sk", "rk_", "aiza", "hf_", "npm_", "pypi", "sg.", "ac")),
        Rule("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{5,2000}\.[A-Za-z0-9_-]{5,4000}\.[A-Za-z0-9_-]{5,1000}"), fixed(CREDENTIAL), ("eyj",)),
        Rule("auth_header", re.compile(r"(\bBearer\s{1,4}|\bAuthorization\s{0,2}[:=]\s{0,2}(?:Basic\s{1,4}|Token\s{1,4}|Bearer\s{1,4})?)([A-Za-z0-9._~+/=-]{8,2000})", re.I), _auth, ("bearer", "authorization")),
        Rule("keyword_secret", re.compile(rf"\b((?:[A-Za-z0-9]{{1,40}}[_-])?(?:{names}))([\"']?\s{{0,3}}(?:=|:|=>)\s{{0,3}}[\"']?)([^\s\"',;]{{6,300}})", re.I), _keyword,
             ("passw", "pwd", "passphrase", "secret", "token", "api", "access", "private", "credentials")),
        Rule("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"), _email(allowed_domains), ("@",)),
        Rule("phone", re.compile(r"(?<![\w.+-])(?:\+\d(?:[ .()-]{0,2}\d){7,14}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?![\w-])(?!\.\d)"), fixed(PHONE), tuple("0123456789")),
    ]
    if with_ip:
        out.append(Rule("ip", re.compile(r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]{3,39})(?![\w:])(?!\.\d)"), _ip, (".", ":")))
    return tuple(out)


def redact(text: str | None, active: tuple[Rule, ...] | None = None) -> tuple[str | None, dict[str, int]]:
    """The text without what the rules find, and how often each found something."""
    if not text:
        return text, {}
    counts: dict[str, int] = {}
    for rule in active or rules():
        text, n = rule.apply(text, text.lower())
        if n:
            counts[rule.name] = n
    return text, counts


def redact_value(value, active: tuple[Rule, ...], counts: Counter):
    """Any JSON value, with texts and keys redacted at every depth; clashing keys are numbered."""
    if isinstance(value, str):
        out, n = redact(value, active)
        counts.update(n)
        return out
    if isinstance(value, list):
        return [redact_value(v, active, counts) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            key = redact_value(k, active, counts)
            while key in out:
                key += "'"
            out[key] = redact_value(v, active, counts)
        return out
    return value


def redacted(df: DataFrame, text_col: str, id_cols: list[str], active: tuple[Rule, ...] | None = None) -> DataFrame:
    """(ids, redacted, counts as JSON) per row: one Arrow pass over whole texts."""
    active = active or rules()
    ids = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [redact(t, active) for t in batch.column(len(id_cols)).to_pylist()]
            columns = [*[batch.column(i) for i in range(len(id_cols))], pa.array([d[0] for d in done], pa.string()), pa.array([json.dumps(d[1], sort_keys=True) for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*id_cols, "redacted", "counts"])

    return df.select(*id_cols, text_col).mapInArrow(run, f"{ids}, redacted string, counts string")
