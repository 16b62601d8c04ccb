"""The default URL vocabulary: terms by weight. A term of weight `LIMIT` or more is strict, the others are soft."""

LIMIT = 4

#: Our own choice.
WEIGHTS = {
    4: (
        "adult-x adult-video adult-chat bestporn bukkake camgirl camgirls camsex cheap-pills cheap-viagra cialis cumshot cybersex escort-service escorts "
        "fake-passport freeporn gangbang hentai hookers kamagra keygen levitra livesex malware milf milfs nudism onlinepharmacy phentermine phishing porn porno pornhub "
        "pornstar pornstars rolex-replica sexcam sexcams sexshop sextube spam-farm tramadol upskirt viagra warez xanax xhamster xnxx xvideos xxx youporn"
    ).split(),
    3: (
        "adult adults ambien baccarat bets betting blackjack bookmaker casino casinos counterfeit crackz craps erotic erotica fetish gambling hardcore jackpot "
        "livecam lolita naked nude nudes nudity painkillers pharmacy pills poker roulette serials sex sexy slots spam steroids stripper strippers torrent torrents webcam-girls"
    ).split(),
    2: (
        "ads adserver banner-exchange bet botox cashback cheap cheats clickbait clicks cracked crack cracks dating debt diet doorway farm forex hack hacks hot-girls linkfarm "
        "loan loans lottery lotto mlm mortgage payday personals popunder popup proxy replica replicas ringtones singles skimmer sweepstakes swinger swingers track tracker tracking webcam weightloss"
    ).split(),
    1: (
        "bargain bonus buy click coupon coupons deal deals discount discounts download downloads earn free freebie freebies gift girls hot instant money now offer offers "
        "online prize prizes profit promo rich save sale subscribe trial unlimited vip win winner winners"
    ).split(),
}

VOCABULARY = tuple((term, weight) for weight, terms in WEIGHTS.items() for term in terms)
