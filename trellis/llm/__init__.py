"""Training-data operators: thirteen distributed passes over a corpus, each in
a module of its own, and the queries that apply them (``queries``)."""
