"""Addresses: pages, e-mails, the companies and accounts they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Form of an e-mail address, public suffixes of two parts, and hosts of private mail.
EMAIL_FORM = r"^[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})$"
TWO_PART_SUFFIXES = ["co.uk", "ac.uk", "gov.uk", "org.uk", "co.jp", "ac.jp", "or.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.mx", "com.sg", "co.in", "com.cn"]
PRIVATE_HOSTS = ["gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "icloud.com", "me.com", "mac.com", "aol.com", "proton.me", "protonmail.com", "pm.me", "duck.com", "msn.com", "fastmail.com", "fastmail.fm"]


def url_key(url: Column) -> Column:
    """Lower-case address without blanks and slashes at its end; null if nothing is left."""
    bare = F.lower(F.regexp_replace(F.trim(url), "/+$", ""))
    return F.when(bare != "", bare)


def email_key(email: Column) -> Column:
    """Lower-case address, null without an @."""
    return F.when(email.contains("@"), F.lower(F.trim(email)))


def email_domain(email: Column) -> Column:
    """Registered domain of a work address: two labels, three under a suffix of two parts; null for other texts and private mail."""
    host = F.lower(F.regexp_extract(F.trim(email), EMAIL_FORM, 1))
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    domain = F.when(last(2).isin(TWO_PART_SUFFIXES) & (F.size(labels) >= 3), last(3)).otherwise(last(2))
    return F.when((host != "") & ~domain.isin(PRIVATE_HOSTS), domain)


def domain_slug(domain: Column) -> Column:
    """First label of a domain, the likely slug of its company."""
    return F.split_part(domain, F.lit("."), F.lit(1))


def company_page_slug(url: Column) -> Column:
    """The part after ``/company/`` of an address, or its first part; null if there is none."""
    bare = url_key(url)
    after = F.when(bare.contains("/company/"), F.regexp_extract(bare, "(?s)/company/(.*)$", 1)).otherwise(bare)
    slug = F.split_part(after, F.lit("/"), F.lit(1))
    return F.when(slug != "", slug)


def path_slug(url: Column) -> Column:
    """The path part that follows a part ``company``, spelling kept; null if there is none."""
    slug = F.regexp_extract(url, "(?:^|/)company/+([^/]+)", 1)
    return F.when(slug != "", slug)


def code_account(organizations: Column) -> Column:
    """First account at the code host in an array of structs (name, url): by a page of it under a name that tells so, or a name ``GitHub: account``.

    Pages are read in lower case; names keep their spelling.
    """
    name = lambda o: F.trim(F.coalesce(o["name"], F.lit("")))
    paged = lambda o: F.regexp_extract(F.lower(F.trim(F.coalesce(o["url"], F.lit("")))), "github\\.com/([^/]*)", 1)
    said = lambda o: F.trim(F.regexp_extract(name(o), "(?i)^github:(.*)$", 1))
    told = lambda o: F.when(F.lower(name(o)).contains("github") & (paged(o) != ""), paged(o)).when(said(o) != "", said(o))
    return F.try_element_at(F.filter(F.transform(organizations, told), lambda x: x.isNotNull()), F.lit(1))
