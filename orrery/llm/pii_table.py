"""The labelled table that the field learns from: invented lines, with personal data marked as ``{kind|text}``."""

from __future__ import annotations

import re

KINDS = "email", "ip", "card", "phone"

LINES = """
Please write to {email|dana.whitlock@harborline.example.com} before Friday noon.
My address is {email|r_okafor(at)mailhouse.org} and I answer within a day.
Send the form to {email|support[at]northfield.co.uk}, not to the office.
{email|jo+lists@quietpond.net} {email|mira.solberg@uni-fjord.no} {email|t.ruiz(at)correo.mx}
Contact: {email|ana_beltran@servicios.es}; {email|kl.brandt[at]werkstatt.de}; {email|info@atelier-lune.fr}
From: {email|newsletter-2041@offers.shopmail.com} To: {email|pat88@inbox.io}
Escribe a {email|luisa.mar[at]playa.es} o llama al {phone|(952) 413-7786} por la tarde.
Schreiben Sie an {email|h.vogt(at)post-amt.de} oder rufen Sie {phone|+49 30 9018820} an.
Appelez le {phone|+33 1 70 18 99 40} ou le {phone|01-70-18-99-41} avant midi.
Call {phone|(415) 555-0132} or {phone|415-555-0199} after six.
Tel. {phone|+44 20 7946 0958}, fax {phone|+44 20 7946 0959}, mobile {phone|07700-900-461}
Her number was {phone|555-867-5309} and nobody forgot it.
Reach me on {phone|[212] 555-7788} during the week or {phone|212.555.7799} at the weekend.
Emergency line {phone|+1 (800) 555-0147} is open all night.
Mein Handy: {phone|+49 (0)171 3920044} und im Büro {phone|(089) 44-120-55}
{phone|(303) 555-4410} {phone|(303) 555-4411} {phone|303-555-4412}
phone={phone|+61-2-5550-1234} name=Olive city=Perth
Llámame al {phone|+34 612 345 678} cuando llegues a la estación.
The caller left {phone|1-888-555-6262} and hung up at once.
Téléphone {phone|(514) 555-2201} poste 12
Server {ip|10.24.7.131} did not answer the request from {ip|192.168.44.2} in time.
{ip|203.0.113.77} {ip|198.51.100.4} {ip|172.31.9.250}
Blocked {ip|85.214.132.117}, allowed {ip|9.9.9.9}, unknown {ip|100.64.0.1}.
El equipo {ip|190.85.12.200} está en la sala tres.
host {ip|127.0.0.1} port 8080 since 2019
Login from {ip|46.101.3.88} at 23:14:05 by user klaus
L'adresse {ip|193.252.19.3} appartient au fournisseur.
Die Adresse {ip|212.227.15.9} gehört zum alten Netz.
Card {card|4929 1283 7746 0012} expires 09/27 and is in the name of her aunt.
pay with {card|5275-9904-3821-7765} or {card|371449635398431} today
The charge on {card|6011000990139424} was refused twice.
Tarjeta {card|4556 7375 8689 9855} a nombre de Rosa Vidal
Karte {card|5610591081018250} gültig bis 03/29
carte {card|4000-0566-5566-5556} refusée au guichet
{card|30569309025904} {card|3530111333300000} {card|4222222222222222}
number {card|4716 2210 5188 5662}, cvc 318, paid 42.50
He wrote {card|5105 1051 0510 5100} on the back of {card|4111111111111111} by mistake.
The meeting on 2021-03-14 was moved to 2021-04-02 because of the storm.
Version 4.18.2 fixes what 4.18.1 broke, and 12.0.3 is next.
On 14.07.1789 a crowd took the fortress, as every child learns.
It cost $1,299.00 in May and 1.049,50 in June.
Chapter 12-14 covers pages 301-356, see also 7-9.
The code is B-2047-XK and the lot 8841-33-C, both void.
Pi is 3.14159 and e is 2.71828, or so they say.
Room 204 (second floor) seats 45 people; room 310 seats 12.
Between 1914-1918 and 1939-1945 the town lost its bells.
They met at 10.30 and left at 17.45 on the 21st.
Order 0048213377 shipped 2 of 3 items; order 0048213390 waits.
Temperatures fell from 12.5 to -3.0 within 36 hours.
See section 3.2.1 and table 4.7, or figure 2.10 on page 88.
In 1066 and 1492 and 1969 things changed for good.
serial 99120044718820031 was read as 99120044718820037 by the scanner
id 20391284756610293847 and key 58a91c0d77e2 are not numbers one calls
ISBN 978-3-16-148410-0 and ISBN 0-306-40615-2 were both out of print.
Die Fassung vom 03.10.1990 gilt, nicht die vom 01.01.1980.
La ley 39-2015 del 01-10-2015 fue publicada el 02-10-2015.
Le match s'est fini 3-2 après 120 minutes; le suivant 0-0.
The ratio was 16:9, then 4:3, and at last 2.39:1.
Coordinates 52.5200 and 13.4050, height 34.7, error 0.002
update 1.2.3.4.5 is not an address, and neither is 300.400.500.600 here
file_2020-11-05_0001.csv and file_2020-11-06_0002.csv hold 9000 rows each
total=48 mean=3.25 max=19 min=-4 n=10000
Some words (such as these) stand in brackets [as do these] and mean nothing.
Write me@ or at. if you must, but the well-known e-mail stays unknown.
example.com and docs.example.org/path are places, not people.
the of and to in a is that it was for on are with as his they at be this
Ein kurzer Satz ohne Zahlen steht hier und sagt nicht viel.
Una frase corta que no dice nada a nadie, salvo la verdad.
Une phrase courte, sans chiffres, qui ne dit presque rien.
Filed 1998-11-23, amended 1999-02-17, repealed 2004-08-30.
2016-06-01 rain 2016-06-02 sun 2016-06-03 fog
Born 1952-12-09 in a village that 1967-07-19 a flood took away.
backup-2022-09-18 and backup-2022-09-25 are both empty
am 2013-05-05 und am 2013-05-19 war das Tor zu
el 2010-10-10 nació su hija, y el 2012-12-12 su hijo
le 2001-01-07 il neigeait, le 2001-01-08 non
He ordered 3 books, 14 pens, 250 sheets, 1200 nails and 86400 stamps.
Of 30517 votes 12044 went to her, 9 to him and 811456 to nobody.
The (old) mill and the (new) one stand by the (dry) river.
los (pocos) amigos y las [muchas] cartas
One may write {email|ada(at)lind.se} or {email|bo[at]hagen.dk} or just {email|cy@moss.ie} there.
weder {email|ute.klee(at)gmx.example.de} noch {email|otto[at]brief.net} hat geantwortet
ni {email|paco(at)sol.com} ni {email|lola[at]luna.net} ni {email|ines.p@mar.es} dijeron nada
ask {email|nobody(at)nowhere.com} the time
von {email|kasimir[at]turm.org} kam ein Brief an {email|wanda(at)schloss.com} zurück
et {email|odile(at)ferme.com} a écrit à {email|remi[at]quai.net} le soir
words here {email|pen.42@ink.blot.com} and there {email|quill.17@nib.dot.net} and so on
only {email|tintin.31@lune.rocket.com} knew
ping {ip|77.88.8.8} took 12 ms and ping {ip|164.70.2.19} took 340
de {ip|5.6.7.8} a {ip|250.249.3.61} sin ruido
unter {ip|141.20.1.3} steht nichts mehr
the {ip|61.9.188.7} and {ip|8.26.56.26} went silent at noon
vers {ip|109.0.66.10} tout est calme
mit {card|4012 8888 8888 1881} und {card|4917610000000000} bezahlt
la {card|5019717010103742} et la {card|6331-1019-9999-0016} sont perdues
lost {card|4484070000000000} near the river, found {card|3566 0020 2036 0505} in it
de {phone|902-114-7765} a {phone|(902) 114-7766} y otra vez {phone|+52 555 1234567}
dort {phone|+41 442 7719003} oder hier {phone|(044) 771-9004}
Copyright 2008-2016 by the authors, all rights reserved under section 7.
Released under the MIT license, version 2.0 of 01/2004, see LICENSE.txt
### $$$ *** --- +++ === ~~~ ||| ### $$$ *** ---
aaaa--bbbb ++cc [x] (y) @z #1 $5 %20 &amp @home @9 a@b
""".strip().split("\n")

_MARK = re.compile(r"\{(\w+)\|([^}]*)\}")


def labelled(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The line without its marks, and (start, end, number of the kind) of what they enclose."""
    out, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        out += line[at : m.start()]
        spans.append((len(out), len(out) + len(m[2]), KINDS.index(m[1])))
        out += m[2]
        at = m.end()
    return out + line[at:], spans


def table() -> list[tuple[str, list[tuple[int, int, int]]]]:
    return [labelled(line) for line in LINES]
