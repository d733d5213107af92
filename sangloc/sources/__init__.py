"""Reading postings and lexicons, writing moderated tables."""
