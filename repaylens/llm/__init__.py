"""Operations on a text corpus for the training of language models."""
