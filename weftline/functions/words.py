"""Word lists for readable values. They are this library's own and fixed, so that values stay the same over versions."""

# Fixed values.
FIRST = "Ada Ben Cleo Dan Eva Finn Gina Hugo Ines Jon Kira Leo Mara Nils Olga Paul Quinn Rosa Sam Tess Uma Vera Walt Xenia Yara Zeno".split()
LAST = "Abel Baker Castro Dahl Egger Fischer Garcia Hansen Ito Jensen Keller Lopez Meyer Novak Okoro Petit Quist Rossi Silva Tanaka Ueda Varga Weber Xu Young Zeller".split()
WORDS = "amber basin cedar delta ember field grove harbor island jetty kernel lantern meadow north ocean prairie quarry river stone timber upland valley willow yonder zephyr".split()
STREETS = "Main Oak Pine Maple Cedar Lake Hill Park River Church Mill School".split()
STATES = "Alba Borea Corva Delme Esta Faro Gala Hesse".split()
DOMAINS = ["example.com", "example.org", "example.net"]
# City, region, country, country code, latitude, longitude.
CITIES = [
    ("Amsterdam", "North Holland", "Netherlands", "NL", 52.37, 4.9),
    ("Berlin", "Berlin", "Germany", "DE", 52.52, 13.4),
    ("Chicago", "Illinois", "United States", "US", 41.88, -87.63),
    ("Dublin", "Leinster", "Ireland", "IE", 53.35, -6.26),
    ("Lagos", "Lagos", "Nigeria", "NG", 6.52, 3.38),
    ("Lima", "Lima", "Peru", "PE", -12.05, -77.04),
    ("Madrid", "Madrid", "Spain", "ES", 40.42, -3.7),
    ("Mumbai", "Maharashtra", "India", "IN", 19.08, 72.88),
    ("Munich", "Bavaria", "Germany", "DE", 48.14, 11.58),
    ("Osaka", "Osaka", "Japan", "JP", 34.69, 135.5),
    ("Paris", "Ile-de-France", "France", "FR", 48.86, 2.35),
    ("Recife", "Pernambuco", "Brazil", "BR", -8.05, -34.88),
    ("Seattle", "Washington", "United States", "US", 47.61, -122.33),
    ("Sydney", "New South Wales", "Australia", "AU", -33.87, 151.21),
    ("Toronto", "Ontario", "Canada", "CA", 43.65, -79.38),
    ("Vienna", "Vienna", "Austria", "AT", 48.21, 16.37),
]
