"""Operations on training data for language models; nothing outside this subpackage imports it."""
