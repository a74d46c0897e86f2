"""Runs of ids: the words of a piece come at once, a long word as a stream between them."""

from stavelake.llm import bpe


def test_words_of_a_piece_are_one_run():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, library = bpe.Encoder(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    long = "ab1c" * 80
    for text, lists in (("the cat, the cats' and unheardofword unheardofword 12", 1), ("", 1), ("one two " + "q" * 300 + " three two", 2), ("x" * 257, 2),
                        (f"über {long} straße Σας", None)):
        runs = list(enc.encode(text))
        assert lists is None or sum(isinstance(r, list) for r in runs) <= lists
        assert [i for r in runs for i in r] == library.encode(text, add_special_tokens=False).ids
        again = [i for r in enc.encode(text) for i in r]
        assert again == library.encode(text, add_special_tokens=False).ids
        for joined in (True, False):
            one, all_ = bpe.Decoder(enc, joined), bpe.Decoder(enc, joined)
            assert "".join(map(one.feed, again)) + one.close() == all_.feed_all(again[:2]) + all_.feed_all([]) + all_.feed_all(again[2:]) + all_.close()


def test_short_words_are_those_of_the_stream_and_fits_outlive_a_task():
    import public_tokenizers

    enc = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("a", "cat", "unheardofword", "straße", "ab1c" * 20):
        symbols = list(enc._symbols(word))
        assert enc.transducer.short(symbols) == list(enc.transducer.run(symbols))
    list(enc.encode("the cat"))
    enc.forget()
    assert not enc.cache and enc.m._fits
