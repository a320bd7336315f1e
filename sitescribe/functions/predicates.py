"""Conditions on pages, runs and viewers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addresses as A

# Statuses by which a site refuses, and the number of words that make real content.
REFUSED, SUBSTANTIVE = [401, 403, 429, 503], 50
# First parts of addresses that nobody reads.
UNREAD = "noreply no-reply donotreply do-not-reply mailer-daemon postmaster webmaster abuse bounce bounces daemon unsubscribe spam root".split()


def start_page_blocked(status: Column, title: Column, words: Column, challenges: list[str]) -> Column:
    """Why a start page counts as blocked: its status alone, or a challenge's title with little text; else null."""
    challenged = F.exists(F.array(*map(F.lit, challenges)), lambda c: F.lower(title).contains(c))
    return F.when(status.isin(*REFUSED), F.concat(F.lit("http "), status.cast("string"))).when(challenged & (words < SUBSTANTIVE), F.lit("challenge page"))


def worth_writing_to(email: Column) -> Column:
    """Not an automatic address, and a local part of two characters or more."""
    local = F.lower(F.substring_index(email, "@", 1))
    return (F.length(local) >= 2) & ~local.rlike("^(" + "|".join(UNREAD) + ")")


def enough_content(words: Column) -> Column:
    """Of a group's pages, three or more carry real content."""
    return F.count_if(words >= SUBSTANTIVE) >= 3


def public(visibility: Column, owner: Column, listed: Column, status: Column) -> Column:
    return (visibility == "public") & owner.isNull() & listed & (status == "succeeded")


def owned(owner: Column, user) -> Column:
    return owner.eqNullSafe(F.lit(user))


def claimable(owner: Column, created_at: Column, now: Column, hours: int = 24) -> Column:
    return owner.isNull() & (created_at + F.make_interval(hours=F.lit(hours)) <= now)


def cooled_down(updated_at: Column, now: Column, minutes: int = 60) -> Column:
    return now >= updated_at + F.make_interval(mins=F.lit(minutes))


def comparable(before: Column, after: Column) -> Column:
    """Score versions that may be compared: equal ones, or one that is unknown."""
    return F.coalesce(before == after, F.lit(True))


def viewer_role(owner: Column, viewer: Column, visibility: Column) -> Column:
    return (
        F.when(owner.isNotNull() & (owner == viewer), "owner").when(owner.isNull(), "ownerless_public")
        .when((visibility == "public") & viewer.isNull(), "anonymous_public").when(visibility == "public", "public_non_owner")
    )


def internal_host(host: Column) -> Column:
    """Names and literal addresses of machines that are not on the public net; addresses in any notation, and no host at all."""
    h = F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"\.$", "")
    named = (h == "") | (h == "localhost") | h.rlike(r"\.(internal|local|localhost)$")
    return A.let(A.address_digits(h), lambda digits: F.when(digits.isNotNull(), ~A.public_address(digits)).otherwise(named))
