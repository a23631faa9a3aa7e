"""Token-usage fields of a stored model response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_usage(response: Column) -> Column:
    """Cached and uncached prompt tokens from the alternative JSON paths; zero counts as missing."""

    def field(path: str) -> Column:
        value = F.get_json_object(response, path).try_cast("long")
        return F.when(value != 0, value)

    token_usage = [f"$.response_metadata.{name}" for name in ("token_usage", "usage")]
    hit = [field("$.usage_metadata.input_token_details.cache_read")]
    hit += [field(f"{base}.prompt_tokens_details.cached_tokens") for base in token_usage]
    hit += [field(f"{base}.prompt_cache_hit_tokens") for base in token_usage]
    miss = [F.get_json_object(response, f"{base}.prompt_cache_miss_tokens").try_cast("long") for base in token_usage]
    return F.struct(F.coalesce(*hit).alias("hit_tokens"), F.coalesce(*miss).alias("miss_tokens"))
