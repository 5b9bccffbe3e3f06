"""Set-at-a-time analytics over an inflectional lexicon, declared as Spark DataFrame plans."""
