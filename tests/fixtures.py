"""Small inputs with one expected value per rule branch."""

CRM_COLUMNS = "pos int, customer_id string, name string, email string, phone string, company string, revenue string, status string, last_contact string"
CRM = [
    (0, "K01", "Petra Novak", "petra.novak@lindenbau.de", "(212) 606-7788", "Linden Bau Corp", "41000", "active", "2023-05-04"),
    (1, "K02", "Omar Haddad", "omar@quarzworks.io", "646-818-2020", "Quarzworks Inc", "64000", "active", "2023-05-09"),
    (2, "K03", "Ines Ferreira", "ines.ferreira@post.pt", "", "Maris LLC", "18000", "inactive", "2022-11-30"),
    (3, "K04", "Yuki Tan", "", "917.303.4040", "Northlight", "", "active", ""),
    (4, "K05", "Bruno Keller", "bkeller@alpenrail.ch", "(212) 909-1010", "Alpenrail Group", "130000", "potential", "2023-06-01"),
    (5, "K02", "Omar L Haddad", "o.haddad@quarzworks.io", "6468182020", "Quarzworks Inc", "66500", "active", "2023-05-11"),
    (6, "K06", "Greta Lindqvist", "greta@fjordlab.se", "718-505-6060", "", "9000", "active", "2023-05-15"),
    (7, "K07", "Tomas Vesely", "t.vesely@broken-mail", "no number", "Vesely Advice", "lots", "unclear", "soon"),
]
TICKETS = [
    ("T-1", "Petra Novak from Linden Bau Corp", "petranovak@lindenbau.de", "2023-05-05", "$900 daily loss", "frustrated"),
    ("T-2", "Omar at Quarzworks", "omar@quarzworks.io", "2023-05-10", "minimal", "concerned"),
    ("T-3", "Ines from Maris", "ines.ferreira@maris.pt", "2023-04-12", "account at risk", "angry"),
    ("T-4", "Yuki Tan - Northlight", "y.tan@northlight.jp", "2023-05-14", "potential upsell $30k", "interested"),
]
PAYMENTS = [
    ("P-1", "K01", "3416.67", "2023-05-01", "completed"),
    ("P-2", "K02", "5200.00", "2023-05-02", "completed"),
    ("P-3", "K05", "9000.00", "2023-05-15", "pending"),
    ("P-4", "K03", "1500.50", "2022-12-01", "failed"),
    ("P-6", "Omer Haddad", "5300.00", "2023-05-22", "completed"),
    ("P-7", "K99", "4000.00", "2023-05-20", "completed"),
]
COMPLAINTS = [
    (1, "@united UA731 on 3/04 cancelled at DEN, I want a refund", "2015-03-04"),
    (2, "@AmericanAir AA218 delayed 4 hours at DFW on March 5th", "2015-03-05"),
    (3, "@Delta DL642 from ATL to BOS got cancelled yesterday, give me my refund", "2015-03-07"),
    (4, "@AmericanAir worst trip of my life, never again", "2015-03-04"),
    (5, "@SouthwestAir WN377 delayed 2 hours at MDW on 3/08", "2015-03-08"),
    (6, "@united charged a baggage fee and lost the bag on UA590 from DEN to SFO on 3/10", "2015-03-10"),
    (7, "@Delta the WiFi for $25 on DL415 never worked on 3/08", "2015-03-08"),
    (8, "no plane for us from ATL to LHR on 3/07", "2015-03-07"),
]
FLIGHTS = [
    (1, "2015-03-04", "UA", "731", "DEN", "SFO", "0", "0", "1", "A"),
    (2, "2015-03-05", "AA", "218", "DFW", "MIA", "110", "240", "0", None),
    (3, "2015-03-06", "DL", "642", "ATL", "BOS", "30", "0", "1", "B"),
    (4, "2015-03-07", "DL", "118", "ATL", "LHR", "60", "0", "Y", "A"),
    (5, "2015-03-08", "WN", "377", "MDW", "LAX", "45", "120", "0.00", None),
    (6, "2015-03-10", "UA", "590", "DEN", "SFO", "15", "30", "N", None),
    (7, "2015-03-08", "DL", "415", "ATL", "LAX", "10", "bad", "0", None),
]


def crm(spark):
    return spark.createDataFrame(CRM, CRM_COLUMNS)


def tickets(spark):
    return spark.createDataFrame(TICKETS, "ticket_id string, customer string, email string, created string, revenue_impact string, sentiment string")


def payments(spark):
    return spark.createDataFrame(PAYMENTS, "transaction_id string, customer_reference string, amount string, pay_date string, status string")


def complaints(spark):
    return spark.createDataFrame(COMPLAINTS, "claim_id int, original_text string, day string")


def flights(spark):
    cols = "fact_id bigint, day string, carrier string, fl_num string, origin string, dest string, dep_delay string, arr_delay string, cancelled string, cancellation_code string"
    return spark.createDataFrame(FLIGHTS, cols).selectExpr("*", "cast(day as date) as flight_date")
