import pytest

from tessera.functions.useragent import parse_user_agent

CASES = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
     ("Windows", "Chrome", "120.0.0.0")),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 "
     "Mobile/15E148 Safari/604.1", ("iPhone", "Safari", "17.0")),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0", ("Linux", "Firefox", "121.0")),
    ("curl/8.4.0", (None, "curl", "8.4.0")),
    ("Googlebot/2.1", (None, "Googlebot", "2.1")),
    ("Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1; Trident/4.0)", ("Windows", "MSIE", "8.0")),
    ("Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko", ("Windows", "MSIE", "11.0")),
    ("Opera/9.80 (Windows NT 6.1) Presto/2.12.388 Version/12.16", ("Windows", "Opera", "12.16")),
    ("Mozilla/5.0 (Linux; U; Android 4.0.3; ko-kr; LG-L160L Build/IML74K) AppleWebKit/534.30 (KHTML, like Gecko) "
     "Version/4.0 Mobile Safari/534.30", ("Android", "Android Browser", "4.0")),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/58.0 Safari/537.36 "
     "OPR/45.0.2552.888", ("Windows", "Opera Next", "45.0.2552.888")),
    ("Mozilla/5.0 (X11; CrOS x86_64 8172.45.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/51.0.2704.64 "
     "Safari/537.36", ("Chrome OS", "Chrome", "51.0.2704.64")),
    ("Mozilla/5.0 (iPad; CPU OS 12_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/74.0 "
     "Mobile/15E148 Safari/605.1", ("iPad", "Chrome", "74.0")),
    ("Wget/1.21.2", (None, "Wget", "1.21.2")),
    ("MyCrawler/3.1 (+http://x.example)", (None, "MyCrawler", "3.1")),
    ("", (None, None, None)),
]


@pytest.mark.parametrize("ua,expected", CASES)
def test_parse_user_agent(spark, ua, expected):
    df = spark.createDataFrame([(ua,)], "agent string")
    r = parse_user_agent(df).first()
    assert (r.platform, r.browser, r.version) == expected
