"""The moderation job over arriving files."""
