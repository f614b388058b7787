from firmaforge.functions import text


def test_phone(apply):
    same = ["0212 345 67 89", "+90 (212) 345-6789", "02123456789"]
    assert apply(text.normalize_phone, same) == ["+902123456789"] * 3
    assert apply(text.normalize_phone, ["5551234567", "+905551234567"]) == ["+905551234567"] * 2
    assert apply(text.normalize_phone, ["", None]) == ["", ""]


def test_email(apply):
    values = ["INFO@Example.COM", "  a@b.co ", "mailto:info@x.com", "no-at.com", "a@nodot", None]
    assert apply(text.normalize_email, values) == ["info@example.com", "a@b.co", "info@x.com", "", "", ""]
    assert apply(text.email_domain, ["A@B.co", "bad"]) == ["b.co", None]


def test_url(apply):
    values = ["www.example.com", "http://www.example.com/", "HTTPS://EXAMPLE.COM", "https://example.com/page//", ""]
    assert apply(text.normalize_url, values) == [
        "https://example.com", "http://example.com", "https://example.com", "https://example.com/page", "",
    ]


def test_domain(apply):
    values = ["https://www.Ex.com:8080/a", "ex.com/a?b", "http://m.ex.com#x", "", None]
    assert apply(text.url_domain, values) == ["ex.com", "ex.com", "m.ex.com", None, None]


def test_city(apply):
    values = ["istanbul", "ANKARA", "izmir", "yeni şehir", " bursa ", ""]
    assert apply(text.normalize_city, values) == ["İstanbul", "Ankara", "İzmir", "Yeni Şehir", "Bursa", ""]


def test_legal_form(apply):
    values = ["Acme Teknoloji A.Ş.", "Beta Limited Şirketi", "Gama Komandit Şirketi", "Delta", "Epsilon Kol. Şti.", "Zeta Şahıs Şirketi"]
    assert apply(text.legal_form, values) == [
        "Anonim Şirket", "Limited Şirket", "Komandit Şirket", None, "Kolektif Şirket", "Şahıs Şirketi",
    ]


def test_name(apply):
    values = ["  acme   teknoloji  A.Ş.", "BETA TIC. LTD. ŞTİ.", "Gama & Delta - Holding!", "İNŞ Yapı", None]
    assert apply(text.normalize_name, values) == [
        "ACME TEKNOLOJI", "BETA TİCARET", "GAMA & DELTA - HOLDING", "İNŞAAT YAPI", "",
    ]


def test_match_key(apply):
    assert apply(text.match_key, ["Çağrı Işık A.Ş."]) == ["CAGRIISIK"]
    assert apply(lambda c: text.match_key(c, compat=True), ["Çağrı İşık A.Ş."]) == ["ARIK"]


def test_address(apply):
    assert apply(text.normalize_address, [" Gül Mah.  Ata Cad. No:3  "]) == ["Gül Mahallesi Ata Caddesi No:3"]
    assert apply(text.address_city, ["A Sok., Kadıköy , TR", "no comma", None]) == ["Kadıköy", None, None]


def test_country(apply):
    assert apply(text.country_code, ["Republic of TURKEY", "Fransa", "germany"]) == ["TR", None, "DE"]


def test_tokens(apply):
    assert apply(text.tokens, ["İstanbul'da, Çay-Evi_2!"]) == [["istanbul", "da", "cay", "evi", "2"]]
    assert apply(lambda c: text.tokens(c, ["için"]), ["çay için icin"]) == [["cay", "icin"]]
    assert apply(text.token_count, ["İstanbul'da, Çay-Evi_2!"]) == [5]
    assert apply(text.edge_ngrams, ["abcd", "a"]) == [["ab", "abc", "abcd"], []]
    assert apply(text.email_tokens, ["Info@X.com"]) == [["info", "x.com"]]
