"""Column functions: text normalisation, identifiers, lexical metrics, fuzzy hashes."""
