"""Work addresses and salted codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# Domains of free consumer mail.
CONSUMER = (
    "gmail.com googlemail.com yahoo.com yahoo.co.in hotmail.com outlook.com live.com icloud.com me.com aol.com proton.me "
    "protonmail.com gmx.com mail.com yandex.com zoho.com rediffmail.com"
).split()


def well_formed(email: Column) -> Column:
    return F.coalesce(email.rlike(EMAIL), F.lit(False))


def domain(email: Column) -> Column:
    return F.when(well_formed(email), F.lower(F.substring_index(email, "@", -1)))


def at_company(email: Column, company: Column) -> Column:
    """Of the company's domain or one below it, and not of a consumer domain."""
    own, wanted = domain(email), F.lower(F.trim(company))
    fits = (own == wanted) | F.endswith(own, F.concat(F.lit("."), wanted))
    return F.coalesce((wanted != "") & ~own.isin(CONSUMER) & fits, F.lit(False))


def salted(salt: Column, code: Column) -> Column:
    return F.sha2(F.concat(salt, code).cast("binary"), 256)
