"""Small column rules used in several places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Vote types of catalog entries and of entities, voter id form, public page address.
CATALOG_VOTE_TYPES = ["want_to_play", "wait_and_see", "not_interested"]
ENTITY_VOTE_TYPES = ["good", "bad", "unknown"]
VOTER_ID_FORM = "^[A-Za-z0-9._:-]{8,256}\\z"
PAGE_ADDRESS = "https://www.youtube.com/"


def is_valid_voter(voter: Column) -> Column:
    return F.coalesce(voter.rlike(VOTER_ID_FORM), F.lit(False))


def is_valid_vote(vote_type: Column, allowed: list[str]) -> Column:
    return F.coalesce(vote_type.isin(allowed), F.lit(False))


def vote_outcome(previous: Column, requested: Column) -> Column:
    """recorded for a first vote, already_recorded for a repeat, updated for a change."""
    return (
        F.when(previous.isNull(), "recorded").when(previous == requested, "already_recorded").otherwise("updated")
    )


def entity_page_url(handle: Column, external_id: Column) -> Column:
    """Public page address from the handle, else from the external id, else NULL."""
    at_handle = F.when(handle.startswith("@"), handle).otherwise(F.concat(F.lit("@"), handle))
    return F.when(handle != "", F.concat(F.lit(PAGE_ADDRESS), at_handle)).when(
        external_id != "", F.concat(F.lit(PAGE_ADDRESS + "channel/"), external_id)
    )


def fill_missing(kept: Column, removed: Column) -> Column:
    """Value of the kept row, else of the removed row."""
    return F.coalesce(kept, removed)


def best_thumbnail(thumbnails: Column) -> Column:
    """Largest available picture address."""
    return F.coalesce(thumbnails["high"]["url"], thumbnails["medium"]["url"], thumbnails["default"]["url"])


def optional_number(text: Column) -> Column:
    """A whole number, or NULL for missing, empty and non-numeric text."""
    number = F.trim(text).try_cast("double")
    finite = (~F.isnan(number)) & (F.abs(number) != float("inf"))
    return F.when((text != "") & finite, number).cast("long")
