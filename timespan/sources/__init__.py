"""Readers and writers of subtitles, transcripts, logs and samples."""
