"""URL and host handling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.words import bind, has_any, literals, truthy_text

_SPACE = " \t\n\r\f\x0b"


def netloc(url: Column) -> Column:
    """Network location exactly as written (user info and port kept); empty when there is no valid scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def canonical_domain(value: Column) -> Column:
    """Host of a URL or bare domain: lower case, port and one leading ``www.`` dropped; NULL when empty."""
    whole = F.regexp_replace(F.btrim(value, F.lit(_SPACE)), r"^(?!.*://)", "http://")
    return _without_www(F.lower(F.substring_index(netloc(whole), ":", 1)))


def _without_www(host: Column) -> Column:
    """One leading ``www.`` dropped; NULL when nothing is left."""
    bare = F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1 << 30)).otherwise(host)
    return bind(bare, lambda h: F.when(h != "", h))


def registrable_of_host(host: Column, suffixes: Sequence[str] = lx.MULTI_SUFFIXES) -> Column:
    """Last two labels of a host, three under a two-part public suffix, in one pattern match."""
    two_part = "|".join(re.escape(s) for s in suffixes)
    return F.regexp_extract(host, rf"(?:^|\.)((?:[^.]*\.)?(?:{two_part})|[^.]*\.[^.]*|[^.]*)$", 1)


def registrable_of_canonical(host: Column) -> Column:
    """Registrable domain of an already canonical host (a further leading ``www.`` is dropped, as above)."""
    return registrable_of_host(_without_www(host))


def registrable_domain(value: Column) -> Column:
    return registrable_of_host(canonical_domain(value))


def host_without_www(url: Column) -> Column:
    """Network location in lower case with every ``www.`` removed (the loose form used on link lists)."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def is_blocked(value: Column, blocked: Sequence[str] = lx.BLOCKED_DOMAINS) -> Column:
    """True when the registrable domain is on the list; NULL input gives false."""
    return F.coalesce(registrable_domain(value).isin(*blocked), F.lit(False))


def extract_urls(text: Column, pattern: str = lx.URL_PATTERN, trailing: str = lx.URL_TRAILING) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda u: F.rtrim(u, F.lit(trailing)))


def service_domains(url: Column, text: Column, skip: Sequence[str] = lx.SKIP_HOSTS) -> Column:
    """Candidate hosts of one signal: its own URL first, then URLs in the text; ordered and distinct."""
    own = F.when(truthy_text(url).isNotNull(), F.array(url)).otherwise(F.array().cast("array<string>"))
    hosts = F.transform(F.concat(own, extract_urls(text)), canonical_domain)
    return F.array_distinct(F.filter(hosts, lambda h: h.isNotNull() & ~h.isin(*skip)))


def bare_domains(text: Column) -> Column:
    """Domains mentioned without a scheme, lower case, in text order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(lx.BARE_DOMAIN_PATTERN), F.lit(1))
    return F.transform(found, F.lower)


def mentioned_domains(url_domains: Column, text: Column) -> Column:
    """Ordered distinct union of URL hosts and bare mentions."""
    return F.array_distinct(F.concat(url_domains, bare_domains(text)))


def offer_word_near(text: Column, domain: Column, window: int = lx.NEAR_OFFER_WINDOW, low: Column | None = None) -> Column:
    """True when an offer word stands within ``window`` characters of the first mention of ``domain``; ``low`` is the lower-case
    text where that is known."""

    def near(at: Column) -> Column:
        start = F.greatest(at - 1 - window, F.lit(0))
        end = F.least(F.length(text), at - 1 + F.length(domain) + window)
        around = F.substring(text, start + 1, end - start)
        return F.coalesce((at > 0) & around.rlike(lx.NEAR_OFFER_PATTERN), F.lit(False))

    return bind(F.instr(F.lower(text) if low is None else low, F.lower(domain)), near)


# ------------------------------------------------------------------ certificate names
def clean_host(host: Column) -> Column:
    """Leading ``*`` and ``.`` removed."""
    return F.ltrim(host, F.lit("*."))


def ct_keyword_match(host: Column) -> Column:
    name = clean_host(F.lower(host))
    return ~has_any(name, lx.CT_DENY) & has_any(name, lx.CT_KEYWORDS)


def has_harvest_tld(host: Column) -> Column:
    name = clean_host(F.lower(host))
    return bind(name, lambda n: F.exists(literals(lx.HARVEST_TLDS), lambda m: F.endswith(n, m)))


def has_subdomain_signal(host: Column) -> Column:
    name = clean_host(F.lower(host))
    return bind(name, lambda n: F.exists(literals(lx.SUBDOMAIN_SIGNALS), lambda m: F.startswith(n, m)))


def strip_subdomain_signal(host: Column) -> Column:
    name = clean_host(F.lower(host))
    return F.when(has_subdomain_signal(host), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)


def safe_to_probe(domain: Column) -> Column:
    """A public-looking name: has a dot, no local suffix, not an IPv4 literal."""
    local = F.exists(literals(lx.UNSAFE_SUFFIXES), lambda s: F.endswith(domain, s))
    numeric = F.regexp_replace(domain, r"\.", "").rlike(r"^\d+$")
    return F.coalesce(F.contains(domain, F.lit(".")) & (domain != "localhost") & ~local & ~numeric, F.lit(False))
