"""DataFrame operators: rules, lexicon matching, similarity, corpus metrics, verdict."""
