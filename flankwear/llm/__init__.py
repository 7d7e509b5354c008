"""Training-data operators (text corpora, vectors, web pages, dialogues)."""
