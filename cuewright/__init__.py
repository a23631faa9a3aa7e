"""cuewright: time-stamped text (transcripts, captions, chapters, translations) as Spark jobs."""
