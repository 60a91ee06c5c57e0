"""What artists and characters of a post become: a studio, performers or plain tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconloom.functions.normalize import key_ci, tag_key
from reconloom.operators.winner import ordered_ci_distinct

# Markers in the artist category that name nobody.
IGNORED_ARTISTS = ("conditional_dnp", "third-party_edit")


def mapped(names: Column, artists: Column, characters: Column, flat: Column, artists_to: str = "studios", characters_to: str = "performers") -> Column:
    """A struct ``studio, performers, tags`` of a post's tag, artist and character names.

    ``artists_to`` is studios, tags or both: the first usable artist is the studio and the others are tags, or all are
    tags. ``characters_to`` is performers, tags or both. ``flat`` says that the source has one list only: names that are
    artists or characters leave the tags then, however they are spelt. Null arrays count as empty."""
    if artists_to not in ("studios", "tags", "both") or characters_to not in ("performers", "tags", "both"):
        raise ValueError(f"{artists_to}, {characters_to}")
    names, artists, characters = (F.coalesce(c, F.array().cast("array<string>")) for c in (names, artists, characters))
    nobody = lambda a: key_ci(a).isin(*IGNORED_ARTISTS)
    usable = F.filter(artists, lambda a: ~nobody(a))
    gone = artists if artists_to == "studios" else F.filter(artists, nobody)
    gone = F.concat(gone, characters) if characters_to == "performers" else gone
    keys = F.transform(gone, tag_key)
    kept = F.filter(names, lambda n: ~(flat & F.array_contains(keys, tag_key(n))))
    more = F.slice(usable, 2, F.greatest(F.size(usable) - 1, F.lit(0))) if artists_to == "studios" else usable
    cast = characters if characters_to != "performers" else F.array().cast("array<string>")
    first = F.try_element_at(usable, F.lit(1)) if artists_to != "tags" else F.lit(None).cast("string")
    return F.struct(first.alias("studio"), (characters if characters_to != "tags" else F.array().cast("array<string>")).alias("performers"), ordered_ci_distinct(kept, more, cast).alias("tags"))
