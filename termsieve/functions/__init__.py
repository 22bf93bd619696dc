from .clean import (  # noqa: F401
    basic_text, clean_news_text, clean_plain_text, clean_short_text, derive_binary_labels,
    drop_digits, filter_tokens, linguistic_tokens, lower_trim, porter_stem, regex_clean,
    remove_stopwords, replace_emoticons, squash_whitespace, stem_tokens, strip_message_noise,
    strip_punctuation, tokenize_words,
)
