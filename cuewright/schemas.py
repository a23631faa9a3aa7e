"""Schemas of stored records (seconds are doubles, arrays and maps stay nested)."""

from __future__ import annotations

SEGMENT = "text string, start double, duration double, text_vi string, text_tts string"
CHAPTERS = "array<struct<index:bigint,start:double,end:double,title:string,title_vi:string>>"
METADATA = (
    "video_id string, title string, channel string, channel_id string, channel_url string, thumbnail string, "
    "description string, duration double, view_count long, like_count long, comment_count long, "
    "channel_follower_count long, upload_date string, categories array<string>, tags array<string>, "
    f"webpage_url string, chapters {CHAPTERS}, chapters_source string"
)
SUMMARY = (
    "video_id string, summary string, source string, segments long, provider string, model string, created_at double"
)
