"""The labelled table: made sentences, letters, records and lists of everyday German and English with marked persons and numbers.

Frames are written from the language at large, not from any corpus: ``(a|b|c)`` stands for one of the alternatives, ``{name}``,
``{addr}``, ``{enaddr}``, ``{phone}``, ``{email}`` and ``{id}`` for marked places, other braces for unmarked filling. Names are drawn from the
list given, from two tables of common names, and made up of syllables, so that the field has to learn from forms and context.
Frames of the third kind have nothing to find, though much of it looks like names and numbers of persons.
The table has ``ROWS`` rows at most, whatever the corpus.
"""

from __future__ import annotations

import random
import re

from fundstelle.llm.identity import card_check, iban_check, insurance_check, tax_check

ROWS = 30_000

#: Common given and family names, the labelled table's own.
_WOMEN = """Kerstin Sabine Fatma Ingrid Heike Svenja Zoë Aylin Dörte Elif Wiebke Carla Rosa Ella Hanna Paula Mia Inga Sophie Devika Maria Claudia Susanne Monika Petra Birgit Ursula Renate Helga Julia Laura Sarah Lisa Nina Katharina Johanna
Franziska Simone Anja Nicole Tanja Silke Ulrike Cornelia Martina Gabriele Karin Brigitte Hannelore Leyla Zeynep Ayşe Samira Agnieszka Katarzyna Olga Natalia Elena Giulia Francesca Carmen Lucía Camille Amira Sunita Mei Yuki Mary Patricia
Jennifer Elizabeth Emily Charlotte Margaret Alice Grace Rebecca Hannah Rachel Naomi Fiona Siobhan Karen Susan Linda Erika Edith Elke Elisabeth Eva Emma Gisela Gerda Gertrud Hedwig Hilde Ilse Irene Irmgard Jutta Kathrin Christa Christine
Christina Antje Astrid Barbara Beate Bettina Doris Dagmar Annette Andrea Angelika Angela Anke Regina Rita Roswitha Ruth Sigrid Sonja Stefanie Theresa Ute Verena Vera Waltraud Lieselotte Luise Leonie Lea Lara Marie Marion Melanie Merle
Miriam Nadine Pia Rosemarie Sandra Saskia Selma Tina Yvonne Emine Hatice Joanna Magdalena Svetlana Tatjana Irina Anastasia Ludmila Chloe Amy Lucy Jane Jessica Victoria Abigail Olivia Sophia Ava Isabella Nicola Joan Helen Diana Julie
Catherine Kate Amelia Harriet Zara Aisha Maryam Noor Chiamaka Ngozi Thandiwe Keiko Sakura Xin Ling Linh Lan Anh""".split()
_MEN = """Tobias Jürgen Björn Malte René Hanno Mats Nils Felix Henrik Emil Lukas Kemal Nigel Rainer Peter Thomas Michael Andreas Stefan Gerhard Dieter Klaus Manfred Uwe Ralf Frank Jens Dirk Torsten Matthias Christian Daniel Sebastian Florian
Jan Tim Horst Günter Helmut Werner Heinz Karl Friedrich Wilhelm Johann Georg Ludwig Hermann Ali Mustafa Ahmed Hassan Yusuf Murat Omar Piotr Tomasz Ivan Dmitri Marco Luigi José Pablo Pierre Jean Ravi Anil Wei Hiroshi John James Robert
William David Richard Harry George Edward Samuel Benjamin Gareth Kevin Brian Bernd Bernhard Berthold Bruno Alfred Albert Alexander Alois Arnold Arthur August Axel Carsten Christoph Clemens Detlef Dominik Eberhard Eckhard Egon Erich Erwin
Eugen Ewald Fritz Gottfried Gregor Guido Gustav Hans Harald Hartmut Heiko Heinrich Holger Hubert Ingo Jochen Joachim Jörg Josef Julian Kai Konrad Kurt Lars Leon Leonard Lothar Lorenz Marcel Markus Marius Maximilian Mirko Niklas Norbert
Olaf Oliver Patrick Philipp Reinhard Reinhold Robin Roland Rolf Rudolf Rüdiger Simon Steffen Timo Till Udo Ulrich Valentin Veit Volker Walter Wilfried Willi Winfried Mehmet Emre Hakan Cem Deniz Andrzej Marek Paweł Jakub Zbigniew Sergej
Mikhail Vladimir Giovanni Matteo Antonio Carlos Miguel Diego Luc Antoine Mathieu Callum Ian Colin Stuart Adam Luke Mark Paul Steven Neil Graham Kwame Kofi Chinedu Tunde Arjun Vikram Sanjay Jun Kenji Minh""".split()
GIVEN = _WOMEN + _MEN
FAMILY = """Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Werner Krause Lehmann Köhler
Maier Herrmann König Walter Mayer Huber Kaiser Fuchs Peters Lang Scholz Möller Weiß Jung Hahn Schubert Vogel Friedrich Keller Günther Frank Berger Winkler Roth Beck Lorenz Baumann Franke Albrecht Schuster
Simon Ludwig Böhm Kraus Martin Schumacher Krämer Vogt Stein Jäger Otto Sommer Groß Seidel Heinrich Brandt Haas Schreiber Graf Dietrich Ziegler Kuhn Kühn Pohl Engel Horn Busch Bergmann Voigt Sauer Arnold Wolff
Pfeiffer Yildiz Kaya Demir Arslan Aydin Kowalski Nowak Wiśniewski Novak Horvat Rossi Ferrari García Fernández Nguyen Tran Kim Singh Patel Sharma Chen Smith Jones Taylor Brown Williams Wilson Johnson Davies
Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Harrison Fletcher Hawkins Oberbeck Wojcik Jansen Petersen Hansen Brinkmann Dreyer Overbeck Terhorst Lindqvist O'Brien""".split()
_HEADS = "Al An Ar Bar Bern Bier Birk Bog Bor Brand Bro Bur Dah Dam Dorn Eb Eich El Erd Fal Fel Freu Gar Ger Gil Gra Grot Hag Ham Har Has Heid Hel Hil Hol Jag Kal Kam Kes Kla Kor Kram Kro Kur Lam Lau Lem Lin Loh Mar Mat Mor Mun Nag Nie Nor Ober Os Pal Pet Pro Rad Ram Rei Rit Ros Rut Sal San Schal Schar Schim Sei Stra Sud Tal Tem Thie Tor Ul Van Ver Wal War Wei Wen Wil Wit Zan Zeh Zim".split()
_MIDS = " a e en er el ing ke ko l m n ro ra s sch st t te ten z ".split(" ")
_TAILS = "acher ack ade anski auer bach beck berg berger born brecht burg dorf dörfer eck eder el ele er ert felder feld fels fink gruber hagen haus heim held hofer holz horst huber ich ig ing ke kamp ken kirch kopf lachen ler lich lin ling low mann meier meister mer mund müller münder ner nick now old ow pert quist rath ring rodt sen ser ski sky son stedt steiner stock stätter tal thal thaler ung vogt wald weg wein werth wicz wig witz yan z".split()
_GIVEN_HEADS, _GIVEN_TAILS = "Al An Bel Ber Cor Da Dor El Em Fe Fro Ga Gis Hel Hen Ir Ja Jo Ka Ki La Le Lo Ma Mi Na No Ol Pe Ra Ri Ro Sa Se Si Ta Te To Va Vi Wa Ya Za".split(), "a ana bert celine dis ela elle en ena etta ias iel ien ika ina ine io is ke la le lia lo mar mir na nes nja no ra rik rin ris ro ron sa son ta to us vin win".split()
_TITLES = ["Frau ", "Herr ", "Herrn ", "Frau Dr. ", "Herr Dr. ", "Dr. ", "Prof. ", "Prof. Dr. ", "Dipl.-Ing. ", "Frau Prof. ", "Kollege ", "Kollegin ", "Familie ", "Geschäftsführer ", "Hausmeister ", "Schwester ", "Meister ", "Ingenieurin "]
_EN_TITLES = ["Mr ", "Mrs ", "Ms ", "Mr. ", "Mrs. ", "Dr ", "Dr. ", "Professor ", "Sir ", "Captain "]

_PROFESSIONS = """Schlosser Lagerist Minister Sachverständiger Anwalt Richter Lehrer Pfarrer Arzt Zahnarzt Apotheker Händler Bäcker Maler Elektriker Installateur Monteur Mechaniker Techniker Ingenieur Architekt Gutachter Redakteur Journalist
Fotograf Schauspieler Sänger Dirigent Trainer Torwart Stürmer Präsident Kanzler Senator Abgeordneter Bürgermeister Direktor Dozent Forscher Chemiker Physiker Biologe Buchhalter Verkäufer Kassierer Pförtner Hausmeister Gärtner Landwirt
Förster Kapitän Pilot Fahrer Vorarbeiter Polier Schichtleiter Praktikant Azubi Rentner Nachbar Vermieter Mieter Zeuge Kläger Kollege Freund Schüler Student Autor Dichter Maler Komponist Patient Prokurist Notar Betreuer""".split()
_KIN = "Onkel Tante Oma Opa Bruder Schwester Cousine Cousin Pater Pastor Eheleute Familie Mutter Vater Tochter Sohn Prinz Graf Meister Oberst Hauptmann".split()
_EN_PROFESSIONS = "engineer lawyer teacher doctor nurse driver manager inspector mechanic plumber architect reporter singer painter captain coach colleague neighbour friend boss landlord tenant witness author student technician director clerk".split()
_DOES = """sagte rief kam ging schrieb gewann verlor lachte schwieg arbeitet wohnt übernimmt bestätigt reparierte brachte nahm gab fand kaufte verkaufte spielte sang lehrte studierte heiratete starb erklärte forderte lobte kritisierte traf besuchte
fotografierte leitet führt schickt holt hilft fehlt wartet antwortet fragt unterschreibt spricht kocht liest baut fährt misst prüft zeichnet berichtet kündigt klagt bittet dankt grüßt glaubt weiß kennt vertritt betreut beantragt zahlt""".split()
_EN_DOES = """said wrote called came left won lost laughed replaced repaired bought sold took gave found met visited joined signed paid asked answered told hired married died explained denied confirmed accepted refused drove built tested measured
designed noticed reported promised thinks knows wants works lives runs leads helps will can would has had did was is""".split()
# Fillings that are no persons.
_THINGS = """Pumpe Motor Ventil Rechnung Antrag Vertrag Bericht Auto Wagen Hund Katze Schule Schüler Lehrer Kunde Kundin Kollege Chefin Firma Projekt Termin Brief Paket Tür Fenster Halle Lager Regal Maschine Anlage Leitung Kessel Tank
Filter Sensor Kabel Schalter Gehäuse Lager Feder Welle Rad Achse Bremse Schlauch Dichtung Schraube Blech Bauteil Werkstatt Büro Küche Garten Baum Blume Berg Fluss See Wald Feld Straße Brücke Bahnhof Zug Bus Flug Reise Urlaub Sommer Winter
Herbst Frühling Montag Dienstag Freitag Sonntag Januar März Mai Juli Oktober Morgen Abend Nacht Woche Monat Jahr Stunde Minute Angebot Preis Kosten Konto Bank Geld Steuer Versicherung Arzt Klinik Patient Medikament Wasser Strom Gas Luft
Temperatur Druck Spannung Länge Breite Höhe Gewicht Grenzwert Messung Prüfung Abnahme Freigabe Norm Vorschrift Sicherheit Schutz Gefahr Brand Unfall Fehler Störung Meldung Anzeige Bild Ton Film Buch Zeitung Seite Kapitel Tabelle Liste Plan
Zeichnung Muster Probe Charge Serie Stück Teil Gruppe Verein Mannschaft Spiel Tor Sieg Fest Musik Konzert Theater Museum Stadt Dorf Gemeinde Rathaus Amt Gericht Gesetz Urteil Polizei Feuerwehr Armee Regierung Minister Partei Wahl""".split()
_ABSTRACT = """Umgebung Frequenz Toleranz Instanz Bilanz Distanz Differenz Konferenz Lizenz Präsenz Tendenz Kapazität Elektrizität Universität Qualität Aktivität Identität Funktion Aktion Station Nation Region Religion Version Dimension Organisation
Kommunikation Information Produktion Konstruktion Situation Redaktion Mechanismus Tourismus Rhythmus Mathematik Physik Technik Politik Kritik Logik Grafik Elektronik Natur Kultur Reparatur Struktur Figur Literatur Dokument Instrument Argument
Moment Parlament Medikament Ergebnis Ereignis Verzeichnis Verständnis Zeugnis Gefängnis Hindernis Freundschaft Wirtschaft Wissenschaft Landschaft Mannschaft Eigenschaft Gesellschaft Reichtum Eigentum Wachstum Zwilling Frühling Lehrling
Neuling Monaten Tagen Jahren Stunden Wochen Werten Zeiten Geräten Teilen Kindern Häusern Ländern Räumen Fällen Punkten Daten Dingen Grenzen Gründen Mitteln Regeln Schritten Folgen Kräften Freiheit Mehrheit Wahrheit Krankheit Einheit
Möglichkeit Tätigkeit Fähigkeit Geschwindigkeit Flüssigkeit Öffentlichkeit Verantwortung Entscheidung Entwicklung Erfahrung Forderung Erinnerung Bedeutung Lösung Leistung Wirkung Verbindung Verwaltung Regierung Wohnung Zeitung Kleidung
Nahrung Drehzahl Anzahl Merkmal Schicksal Material Personal Kapital Signal Kanal Salz Holz Glas Eisen Kupfer Beton Papier Stoff Zucker Mehl Brot Milch Nässe Kälte Hitze Wärme Stärke Größe Menge Fläche Länge Tiefe Nähe Ruhe Liebe Angst
Öffnen Messen Prüfen Lesen Essen Leben Wissen Lernen Fahren Laufen Warten Reden Schreiben Beladung Lagerung Änderung Wartung Schulung Übung Heizung Lüftung Richtlinie Anleitung Bericht Protokoll Heft Merkblatt Nachweis Hinweis Entwurf""".split()
_EVERYDAY = """Schäden Bänder Gründe Wände Hände Böden Plätze Räder Dächer Bücher Wörter Züge Flüsse Töne Kräne Gäste Ärzte Äste Öfen Vögel Gärten Läden Häfen Nägel Äpfel Möbel Wege Tage Jahre Kinder Leute Menschen Frauen Männer Eltern Augen Ohren
Finger Fuß Bein Arm Kopf Rücken Herz Blut Haut Haar Zahn Stimme Schritt Blick Wort Satz Text Frage Antwort Idee Plan Ziel Zweck Sinn Grund Ursache Folge Wirkung Beispiel Regel Ausnahme Fall Lage Stand Stelle Platz Ort Rand Ecke Kante Spitze Mitte
Anfang Ende Beginn Schluss Pause Dauer Verlauf Ablauf Vorgang Zustand Wert Maß Grad Rest Teil Hälfte Viertel Dutzend Paar Reihe Kette Ring Kreis Linie Punkt Winkel Form Farbe Muster Dicke Schicht Stufe Ebene Klasse Sorte Marke Typ Modell Bauart
Last Kraft Arbeit Energie Hub Schub Zug Stoß Schlag Lärm Staub Rauch Dampf Nebel Regen Schnee Eis Frost Sturm Wind Sonne Mond Stern Himmel Erde Boden Sand Stein Fels Kies Lehm Kalk Gips Ton Zement Asphalt Teer Gummi Leder Wolle Seide""".split()
_TOOLS = """Hammer Zange Säge Bohrer Feile Schlüssel Schloss Riegel Haken Seil Draht Rohr Stange Stab Brett Platte Balken Leiste Latte Rahmen Deckel Boden Griff Hebel Knopf Taste Schalter Stecker Dose Lampe Birne Kerze Batterie Spule Magnet Kern Mantel
Hülse Buchse Bolzen Stift Niet Mutter Scheibe Zahnrad Riemen Nocken Kolben Zylinder Düse Klappe Hahn Pumpe Turbine Gebläse Kühler Heizer Brenner Ofen Herd Kamin Topf Pfanne Teller Tasse Glas Flasche Becher Löffel Gabel Messer Tuch Decke Kissen
Bett Stuhl Tisch Schrank Bank Sofa Teppich Vorhang Spiegel Uhr Koffer Tasche Sack Kiste Karton Korb Eimer Fass Behälter Stapel Palette Wagen Karren Schlitten Kran Aufzug Rampe Treppe Leiter Gerüst Zaun Mauer Wand Pfosten Schild Mast Turm Kabine
Umlauf Abfluss Zulauf Vorrat Bestand Verbrauch Verlust Gewinn Ertrag Umsatz Kauf Verkauf Versand Empfang Eingang Ausgang Zugang Umbau Einbau Ausbau Abbau Aufbau Neubau Tausch Wechsel Ersatz Zusatz Vorsatz Absatz Abrieb Verschleiß Rost""".split()
_NOUN_HEADS = "Haus Schul Auto Werk Druck Wasser Luft Strom Wärme Brems Kraft Mess Prüf Steuer Regel Sicherheits Arbeits Kunden Liefer Lager Bau Garten Stadt Landes Bundes Familien Kinder Jugend Sport Musik Winter Sommer Reise Zeit Geld Bank Daten Netz Signal Schalt Dreh Zug Hub Öl Gas Rohr Kessel Rahmen Klemm Fenster Tür Kühl Heiz Licht Ketten Achs Getriebe".split()
_NOUN_TAILS = "plan buch amt raum tür platte dienst leitung führung anlage sensor pumpe ventil motor kasten meldung prüfung messung stelle stunde gruppe ordnung vorschrift karte kosten gerät zylinder wandler speicher klappe scheibe träger regler verteiler anzeige schalter modul element profil begrenzung überwachung versorgung kammer stecker aufnehmer relais lager halter block hof werk halle schein wagen teil element geschwindigkeit beständigkeit".split()
_STEMS = "Abnahm Erprob Belast Bewert Dämpf Begründ Förd Grenz Kenn Lös Mein Nutz Ordn Plan Richt Schulung Sperr Steiger Teilnahm Umrüst Verzöger Wart Wirk Zähl Zulass".split()
_ADJ = "neu alt groß klein lang kurz gut schlecht schnell langsam rot blau grün warm kalt offen sicher wichtig einfach schwer leicht hoch tief jährlich monatlich täglich elektrisch mechanisch öffentlich privat frisch sauber".split()
_VERBS = "prüft liefert meldet öffnet schließt zeigt braucht sucht findet erhält verliert gewinnt startet stoppt bewegt erwärmt kühlt begrenzt misst steuert ersetzt verbindet trennt schützt erklärt verlangt verhindert".split()
_PARTS = "geprüft geliefert gemeldet geöffnet geschlossen gezeigt gebraucht gesucht gefunden verschoben gestartet gestoppt gesperrt gereinigt gewartet ersetzt verbunden getrennt geschützt erklärt genehmigt abgelehnt bezahlt gedruckt begrenzt überwacht entlastet".split()
_ADVERBS = "heute gestern morgen sofort später regelmäßig gemeinsam selten oft immer zuerst danach dort hier innen außen vollständig teilweise".split()
_EN_THINGS = "pump motor valve invoice contract report car dog school teacher customer company project meeting letter parcel door window hall shelf machine plant pipe boiler tank filter sensor cable switch housing spring shaft wheel brake hose gasket screw workshop office kitchen garden tree river road bridge station train flight holiday summer winter price account bank water power pressure voltage length weight limit test approval standard safety fire accident fault message picture book page chapter table list drawing sample batch guide relay module".split()
_EN_ADJ = "new old large small long short good bad fast slow red blue green warm cold open safe important simple heavy light high low annual electric public private fresh clean".split()
_EN_VERBS = "checked delivered reported opened closed shown needed replaced cleaned measured tested approved rejected paid printed moved cooled heated fitted labelled stored".split()
_UNITS = "N V A C g s h kg mm cm m km Nm Hz bar kPa kΩ µm % °C l/min U/min Euro EUR Stück min ms".split()
_EN_UNITS = "N V A kg mm cm m Nm Hz bar kPa % °C l/min rpm hours days".split()
_TOWNS = "Dortmund Leipzig Köln Hamburg Bremen Kassel Ulm Passau Jena Trier Aachen Erfurt Mainz Lübeck Rostock Potsdam Hagen Siegen Leeds York London Bristol Boston Dublin Wien Graz Bern Basel Zürich".split()
_TOWN_PARTS = ("Alt Neu Nord Süd Ober Unter Hohen Groß Klein Bad Wald Feld Berg Stein Mühl Birken Linden Eichen Erlen Rohr Schön Licht Kalten Quell Falken Weiden Sand".split(), "bach berg brunn burg dorf feld furt hagen heim hausen hofen kirchen lohe moor rode stadt stedt tal wald werder au ried grund".split())
_STREET_HEADS = "Garten Bahnhof Linden Eichen Birken Ahorn Mühlen Kirch Schul Markt Burg Berg Hafen Rosen Wiesen Feld Brunnen Kloster Schloss Post Wald See Ulmen Kastanien Gerber Weber Bäcker Tulpen Amsel Lerchen Mozart Schiller Goethe Bismarck Kant Industrie Werk Kanal Ost West Nord Süd Haupt Ring Rathaus Kupfer Prinzen Kaiser Dorf Mittel Neu Stein".split()
_STREET_TAILS = ["straße"] * 6 + ["str."] * 4 + "strasse weg weg allee platz gasse ring damm ufer wall graben hof steig stieg pfad markt chaussee twiete kamp hang blick grund winkel anger berg bach tal eck garten höhe wiese brink busch".split()
_PLACES = "turm hof brücke mühle wiese garten tor bach see wald kirche ziegelei speicher park brunnen friedhof damm bahnhof hafen schleuse schule kapelle linde eiche quelle werft sportplatz rathaus".split()
_STREET_WHOLE = "Am Fliederhang|Am Stadttor|Am Alten Werktor|Zum Kesselhaus|Zur Alten Mühle|Zur Schleuse|An der Schleuse|An den Eichen|Hinter der Mauer|Hinter dem Bahnhof|Im Winkel|Im Grund|Im Wiesental|Unter den Linden|Straße der Weber|Straße des Friedens|Platz der Einheit|Obere Webergasse|Untere Hofstraße|Alter Graben|Alte Poststraße|Neuer Markt|Großer Hof|Lange Reihe|Hohe Straße|Kleine Gasse|Auf der Höhe|Auf dem Hügel|In der Aue|Stuttgarter Ring|Berliner Straße|Hamburger Allee|Kölner Platz|Wiener Weg|Breslauer Str.|Max-Planck-Straße|Karl-Marx-Allee|Ernst-Abbe-Ring|Clara-Zetkin-Str.|Von-Stauffenberg-Platz".split("|")
_EN_STREETS = "Harbour Mill Castle Maple Turner Quarry North South Station Church Victoria Queen's King's Oak Elm Park Bridge Old Bridge|Albert|Rose Hill|West End|High".replace("|", " ").split()
_EN_TAILS = "Street Street Road Road Lane Avenue Close Drive Way Square Court Place Gardens Terrace Row Hill Grove Crescent Mews Walk Rd St Ave".split()
_HOSTS = "post.example.net example.com example.org werk-sued.example uni-kassel.example mail.test firma.example labor.werk.test buero.example.de web.example gmx.example team.example.co.uk".split()
_BOXES = "info kontakt service office support verwaltung normenstelle einkauf hr noreply sekretariat bestellung vertrieb pruefstelle datenschutz".split()

POSITIVE = r"""
(Gestern|Heute|Vorhin|Am Montag|Letzte Woche) (hat|hatte) (uns|mich|die Firma|das Team) {name} (besucht|angerufen|informiert|verlassen) und mit {name} (gesprochen|gearbeitet|telefoniert).
(Ich|Wir) (habe|haben) (gestern|heute|schon) (mit|bei|von) {title}{name} (gesprochen|gehört|gegessen|gelernt).
Wer {herr}{name} (erreichen|sprechen|treffen) will, (wählt|ruft) {phone} (oder schreibt an {email}|an|und fragt nach {title}{name}).
Meine (Anschrift|Adresse) (lautet|ist) {addr}{town}, (ich heiße|mein Name ist) {name}.
Ich (heiße|bin) {name}(, | und wohne ){inaddr}{addr}{town}.
Mein Name ist {name}, (geboren|gemeldet) in {place}.
{title}{name} wohnt (jetzt|seit Mai|noch|wieder)? {inaddr}{addr}{town}.
(Die|Unsere|Beide|Zwei) (Kollegen|Kolleginnen|Nachbarn|Techniker|Prüfer|Brüder|Freunde) {name} und {name} (kommen|arbeiten|helfen|warten) {adverb}.
(Laut|Nach) (Bericht|Angabe|Auskunft|Meinung|Aussage|Notiz) von {title}{name} (ist|war|bleibt) {np} {part}.
{herr}{name} (leitet|übernimmt|verlässt|führt|vertritt|gründete) (die Abteilung|das Projekt|den Verein|das Büro|die Gruppe) (seit Mai|in {place}|{adverb}).
{title}{name} (leitet|sagte|meint|bestritt|erklärte|ging|kam|schrieb|lacht|fragte|prüfte|öffnete|unterschrieb) {adverb}(, dass {np} {part} ist| {np}| den Vertrag| die Rechnung)?.
"(Das|Es) ist {adj}", (sagte|meinte|rief|erklärte) {title}{name}.
(Der|Unser|Ihr) (Geschäftsführer|Leiter|Vorsitzende|Hausmeister|Trainer|Bürgermeister|Sachbearbeiter|Prüfer|Fahrer|Nachbar) {name} (wohnt {inaddr}{addr}|sagte zu|kommt {adverb}|ist erkrankt|dankt {herr}{name}).
(Die|Unsere|Ihre) (Geschäftsführerin|Leiterin|Ärztin|Lehrerin|Sachbearbeiterin|Prüferin|Nachbarin) {name} (wohnt {inaddr}{addr}|sagte zu|kommt {adverb}|ist erkrankt|hilft {herr}{name}).
(Sehr geehrte|Liebe|Guten Tag|Hallo) Frau (Dr. |Prof. )?{surname}(,|!|\n)
(Sehr geehrter|Lieber|Guten Tag|Hallo) Herr (Dr. |Prof. )?{surname}(,|!|\n)
(Liebe|Lieber|Hallo|Hi|Moin) {first},\n{sentence}
(Vielen Dank|Danke|Gruß) an {title}{name} für (die Hilfe|das Buch|den Hinweis|die Arbeit).
(Bitte|Könnten Sie) (den|die|das) {noun} (an|bei) {title}{name} (abgeben|schicken|abholen).
(Der|Das|Ein) {noun} (gehört|gefällt|fehlt) {herr}{name}, {addr}{town}.
(Das|Dieses) (Buch|Lied|Bild|Gutachten) (ist|stammt) von {name} (und {name})?.
{name} ({phone}) (hilft|antwortet|übernimmt) {adverb}.
(Die|Unsere|Beide|Alle) (Kollegen|Herren|Damen|Prüfer|Nachbarn|Zeugen|Richter|Lehrer|Trainer|Freunde|Autoren|Schwestern|Erben) {surname} und {surname} (haben|hatten|waren|sind|werden|wollen) {adverb} {part}.
(Herr und Frau|Frau und Herr|Dres.|Die Herren) {surname} (haben|waren|sind|wohnen) {adverb}.
{surname} und {surname} (haben|hatten|waren|sind) (am|im) {noun} {part}.
{surname} (hat|hatte|war|ist|bleibt|kam|sagte|schrieb|meint) {adverb}( {part}| krank| da|).
(Mit|Von|Bei|Nach Absprache mit|Nach einem Gespräch mit|Im Beisein von|Auf Antrag von|Zusammen mit|In Vertretung von) {title}{revname} (bleibt|ist|wird|gilt|war) {np} {part}.
(Mit|Von|Bei|Nach Absprache mit|Nach einem Gespräch mit|Im Beisein von|Auf Antrag von|Zusammen mit|In Vertretung von) {title}{name} (bleibt|ist|wird|gilt|war) {np} {part}.
(Please ask|Talk to|A copy for|The key of|Write to|Contact) {entitle}{revname}( at {phone}| <{email}>|).
{name}, {name} und {name} (waren|sind|kamen|blieben) {adverb} (dabei|im {noun}|krank).
{name} sowie {title}{name} (fehlten|haben zugestimmt|wurden gewählt|sind verhindert).
(Anwesende|Teilnehmer|Mitglieder|Entschuldigt|Gäste|Verteiler|Beteiligte|Zeugen)(:| waren| sind) {names}(.|)
(Sitzung|Treffen|Besprechung|Runde) (vom|am) {date}(, Leitung:| / Vorsitz:| - Schriftführung:| / Leitung) {title}{name}( / Gäste: | / dabei: |; Gäste: ){names}
(Vorsitz|Leitung|Notiz|Schriftführung|Moderation): {title}{name} / (Gäste|Dabei|Mit|Eingeladen): {names}
{key}: {title}{name}
{key}: {title}{name}\n{pkey}: {phone}
{key}: {title}{name}\n{mkey}: {email}
{key}: {title}{name}\n{akey}: {addr}{town}\n{pkey}: {phone}\n{mkey}: {email}
{akey}: {title}{name}, {addr}{town}
{akey}: {addr}{town}
{pkey}: {phone}
{mkey}: {email}
{ikey}: {id}
{ikey} {id}
{key} {title}{name} ({ikey}{colon} {id})
{title}{name} ({ikey}{colon} {id}) (hat|wird|ist) {adverb} {part}.
{title}{name} (hat|wurde|hatte) {np} {part}; (siehe|Beleg|Nummer|belegt durch|dazu) {ikey}{colon} {id}.
{title}{name} (hat|hatte) {np} (bestätigt|erteilt|gegeben|unterschrieben); {ikey}{colon} {id}.
{sentence} {title}{name} (hat|hatte) {np} {part}.
{sentence} {title}{name} (hat|hatte) das (erlaubt|bestätigt|unterschrieben); mehr unter {id}.
(Ihre|Meine|Seine) {ikey} (lautet|ist|war) {id}(.| und gilt bis {date}.)
(Meine|Ihre|Die) {ikey} {id} (steht|stand|fehlt) im (Vertrag|Antrag|Brief|Ausweis).
(Den Betrag|Die Miete|Das Geld|Die Summe|Den Beitrag) (bitte |)(auf|an|per) {ikey}{colon} {id} (überweisen|zahlen|senden).
(Zahlung|Gutschrift|Lastschrift|Erstattung) (auf|von|an) {id}( bis zum {date}| erfolgt {adverb}|)(.|)
(Gemeldet|Wohnt|Zustellbar|Zu Hause|Ansässig) (unter |in der |)?{addr}{town}, (Pass|Karte|Ausweis|Nummer) {ikey}?{colon} {id}.
(Wohnort|Sitz|Wohnsitz|Gemeldet) {addr}{town}, (Ausweisnummer|Kennung|Pass|Ausweis) {id}.
(Für|Wegen|Bei) (der|die) (Abrechnung|Erstattung|Anmeldung|Meldung) (ist|wird|bitte) {ikey}{colon} {id} (nötig|gebraucht|nennen|angeben).
(Für|Bei) (Rückfragen|Fragen|Problemen|Notfällen|Reklamationen) (ist|sind|steht|hilft) {title}{name} (unter|Telefon|Tel.|mobil|Durchwahl) {phone} (da|erreichbar|zuständig).
(Wenden Sie sich|Melden Sie sich|Schreiben Sie|Fragen bitte) (an|bei) {title}{name}(, Tel. {phone}|, Telefon {phone}| ({phone})| unter {phone}| <{email}>|, {email})?.
(Sie erreichen|Man erreicht|Ihr erreicht) (mich|uns|ihn|sie|{herr}{name}) (unter|per Telefon|mobil|abends) {phone}( oder {email}| oder per Mail an {email}| sowie {phone}|).
(Meine|Unsere|Die) (neue |)(Nummer|Telefonnummer|Handynummer|Durchwahl|Faxnummer) (ist|lautet) {phone}.
(Ruf|Ruft|Rufen Sie) (mich|uns|{herr}{name}|bitte|dann) {adverb} (an|zurück): {phone}
(Anruf|Rückruf|Nachricht|Fax) (an|von|unter) {phone} (um 8 Uhr|nicht angenommen|bitte {adverb}).
(Unter|Über|Von) {phone} (meldet sich|antwortet|erreichen Sie) (niemand|der Notdienst|{title}{name}|die Zentrale).
(Die Hotline|Der Notruf|Das Telefon|Die Leitung) {phone} ist (nachts|heute|immer) (besetzt|erreichbar|gestört).
(Wähle|Wählt|Wählen Sie) {phone}, (wenn|falls|sobald) {np} {part} ist.
(Schreib|Schreiben Sie|Mail|Mailen Sie) (mir|uns|bitte|dazu) (eine Nachricht |)an {email}(.| oder {phone}.)
(Bewerbungen|Rechnungen|Fotos|Dateien|Anträge|Beschwerden) (bitte |nur |)(an|unter|über|per Mail an) <?{email}>? (senden|schicken|richten)(, nicht an (das Büro|die Post)|).
(Die|Meine|Unsere) (Mailadresse|E-Mail-Adresse|Adresse) (ist|lautet) {email}.
(Der|Ein) {noun} kam von {email}.
(Das Paket|Die Ware|Der Brief|Die Probe|Das Gerät|Die Lieferung) (ging|geht|kommt|wurde|ist) (an|nach|zu)? {addr}{town}(, | )(geschickt|gesendet|geliefert|abgeholt)?(.| ({phone}).)
(Ware|Post|Pakete|Geräte|Unterlagen) (bitte |)(an|zu|nach) {addr}{town} (senden|bringen|schicken|liefern)(, Tor 3| bis 18 Uhr|, Abgabe ab 7 Uhr)?( ({phone})|).
(Treffpunkt|Treffen|Feier|Abholung|Abgabe|Übergabe) (ist |)(um 15 Uhr |am {date} |){inaddr}{addr}{town}(.|)
(Das|Unser|Ein) (Haus|Büro|Laden|Lager|Geschäft) {inaddr}{addr}{town} (ist|wird|wurde) {adverb} {part}.
(Er|Sie) (zog|zieht|wohnte) (von|aus) {inaddr}{addr} (nach|in|zu) {addr}{town}.
{np} (wurde|wird) (von|durch) {title}{name} {part}( und (nach|an|zu) {addr}{town} (gebracht|gesendet|geliefert)|).
{np} (wurde|hat) {title}{name} (am|im|beim) {noun} {part}.
(Auf|Nach|Dank) (Wunsch|Rat|Bitte|Hinweis) (von|durch) {title}{name} (ist|wird|bleibt|wurde) {np} {part}.
(Mit|Ohne|Für|Gegen|Durch|Von|Trotz|Neben) {title}{name} (geht|gilt|wird|ist|war) {np} {part}.
(Nach|Laut|Gemäß) {title}{name} (ist|sei|war|gilt) {np} {part}.
{nsent}
{nsent}
{nsent}
{nsent}
{nsent} {sentence}
{sentence} {nsent}
{nsent} {nsent}
{nsent}\n{sentence}
{ennsent}
{ennsent}
{ennsent} {ensentence}
{ensentence} {ennsent}
(Der|Die|Unser|Unsere|Ihr|Mein|Meine|) {prof} {name} (hat|wurde|wird|ist|will|kann) {np} {part}.
(Zum|Zur) {prof} (wurde|wird) {name} (gewählt|ernannt|bestellt).
(Seine|Ihre|Meine|Unsere) (Frau|Mutter|Tochter|Schwester|Chefin|Freundin) {first} (hat|kommt|ist|war) {adverb} {part}.
(Viele|Liebe|Herzliche|Beste) Grüße (aus {place}|von uns|auch von {first}|), {first}
(Es grüßt|Herzlichst|Dein|Deine|Ihr|Ihre|Bis morgen|Bis bald|Tschüss|Danke),?\n?{first}
(Thanks|Cheers|Best|Love|Yours|Thanks again|Regards),?(\n| ){name}
(Dear|Hi|Hello) {entitle}{name}, {ensentence}
{first} (hat|ist|braucht|will|kommt|kann) {adverb} {np}( {part}|).
(Hat|Ist|War|Will|Kommt) {first} {adverb} {np} {part}?
(Abbuchung|Buchung|Eingang|Bescheid|Antwort|Schreiben|Anfrage|Auskunft|Beleg|Nachweis) (von|zu|auf|an|für|unter|mit) {id} (ist|wird|fehlt|folgt|liegt)( noch| {adverb}| {part}).
{np} {verb} {id}( {adverb}| noch|).
(Das|Mein|Sein|Ihr) (Gebäude|Haus|Büro|Wohnsitz|Grundstück|Laden) (ist|war|liegt|steht)? {addr}( {adverb}|).
(Man findet|Gesucht wird|Zu vermieten|Ich wohne|Er wohnt|Brand|Einsatz|Unfall) {addr}(, {noun}| {adverb}|).
{closing}\n{title}{name}
{closing}\n{name}\n{addr}{town}\n{phone}
{closing}\n{title}{name}\n{addr}{town}\n{phone}\n{email}
{closing}\n{title}{name}\n{addr}\n(Tel.: |Telefon |Fon |T |){phone}\n(Mail: |E-Mail: |){email}\n{sentence}
{closing}\n{first}
{closing}\n\n{name}\n{role}\n{phone}\n\n{sentence}
{sentence} {sentence}\n{closing}\n{name}
(gezeichnet|unterschrieben|i. V.|i. A.|ppa.|gez.|Unterschrift|Im Auftrag)(:|) {title}{name}(\n{addr}{town}|\n{sentence}|)
{head1}{sep}{head2}{sep}{head3}\n{title}{name}{sep}{phone}{sep}{ikey}?{colon} {id}\n{name}{sep}{phone}{sep}{id}
{head1}{sep}{head2}\n{name}{sep}{email}\n{name}{sep}{email}
{head1}{sep}{head4}{sep}{head2}\n{name}{sep}{addr}{sep}{phone}\n{name}{sep}{addr}{town1}{sep}{phone}
{num}{sep}{name}{sep}{addr}{sep}{email}
{name}{sep}{phone}{sep}{id}
{title}{name}{sep}{phone}{sep}{ikey} {id}
{"{jkey}": "{title}{name}", "{jkey2}": "{email}"}
{"{jkey}": "{name}", "{jkey3}": "{phone}", "{word}": {num}}
{"{jkey}":"{name}","adresse":"{addr}{town1}"}
<{jkey}>{name}</{jkey}><{jkey3}>{phone}</{jkey3}>
{name} | {role} | {phone} | {email}
{name} ({role}), {addr}{town}
{name}\n{addr}{town}
{name}
{addr}{town}
{noun} {noun} {addr} {noun} {noun}
{noun} {id} {noun}
{noun} {phone} {noun}
{sentence} {addr} {sentence}
{sentence} {phone}. {sentence}
{sentence} {id}. {sentence}
{sentence} ({email}) {sentence}
{sentence} {title}{name}. {sentence}
{sentence} {herr}{name} {sentence}
(Geburtstag|Jubiläum|Hochzeit|Beerdigung|Abschied|Vertretung|Krankmeldung) (von |für |){title}{name} (am {date}|{adverb}|mit {name}).
(Autor|Autoren|Verfasser|Redaktion|Fotos|Text)(:| von| ) {name}(, {name}|/{name}| und {name}|)
(Zwischen|Vereinbarung zwischen|Vertrag zwischen) {title}{name}, {addr}{town}, und {title}{name}, {addr}{town}
(Die Eltern|Das Ehepaar|Die Eheleute|Die Geschwister|Familie) {name} (und {name} |)(danken|wohnen|klagen) {adverb}.
(Patient|Patientin|Mieter|Mieterin|Kunde|Kundin|Versicherte|Zeuge|Halter|Besitzer|Schüler) {name} (ist|wurde|hat|war) {adverb} {part}.
(Dem|Den|Der) (Mieter|Kunden|Zeugen|Kollegen|Nachbarn) {surname} (wurde|hat|gab) {np} {part}.
(War|Ist|Hat|Kann|Soll) {title}{name} {adverb} (da|hier|helfen|kommen|fertig)?
(Kennst du|Kennen Sie|Hast du|Wo ist|Wer ist) {title}{name}(?| aus {place}?)
Re: {noun} - {name}, {date}
(Von|From): {name} <{email}>\n(An|To): {name} <{email}>\n(Betreff|Subject): {noun}
(Von|Gesendet von|Absender): {email}
Am {date} schrieb {name} <{email}>:
@{first} (schau|prüf|sieh) bitte {np} an.
{entitle}{name} (said|told us|wrote|agreed|denied|explained|reported) (that |)the {enoun} (was|is) {enverb}.
(On Monday|Yesterday|Last week|This morning|In May) {entitle}{name} and {entitle}{name} (inspected|visited|repaired|closed) the {enoun} at {enaddr}{entown}.
{entitle}{name} (denied|signed|checked|left|opened|rejected|inspected|approved) the {enoun}( yesterday| with {name}| at noon|).
(Please|Kindly) (contact|call|ask|write to|email) {entitle}{name} (at|on|via|under) ({phone}|{email}|{phone} or {email}).
(My name is|I am|This is) {name}( and I live at {enaddr}{entown}| from {place}|).
{entitle}{name} lives at {enaddr}{entown}.
(The|Our) (report|letter|invoice|drawing|test) was (written|checked|sent|paid|approved) by {entitle}{name}( and {name}|)(; call {phone} with questions|, {enaddr}|).
(Dear|Hello|Hi) {entitle}{name},\n{ensentence}
(Kind regards|Best wishes|Sincerely|Yours faithfully|Cheers|Many thanks),?\n{name}(\n{enaddr}{entown}|\n{phone}|\n{email}|)
(Signed|Approved|Checked|Prepared|Witnessed)( by|:) {entitle}{name}(\n{ensentence}|)
(Parcels|Samples|Letters|Returns) (go|should go|were sent) to {enaddr}{entown}(, tell {email}| and {email} is told|; phone {phone}|).
(Deliver|Send|Return|Post) the {enoun} to {enaddr}{entown}( and (tell|inform|email) ({email}|{entitle}{name})|).
(Deliver to|Bill to|Attention|Sender|Recipient): {entitle}{name}, {enaddr}{entown}
(Pay|Transfer|Refund) (the fee |it |)(to|from|into) {id}( and (write to|tell|mail) {email}|).
(Questions|Complaints|Applications) (to|for|reach) {entitle}{name}( <{email}>|, {phone}| ({email})|).
(With|Thanks to|Without|According to|After talking to) {entitle}{name} the {enoun} was {enverb}.
(Ask|Meet|Follow|Thank) {name} (about|at|for) the {enoun}.
(Attendees|Present|Participants|Authors|Speakers): {ennames}
{ensentence} {entitle}{name} {enverb} it. {ensentence}
{ensentence} Write to {email} or call {phone}.
(They|We|She|He) (moved|came|drove|walked) from {enaddr} to {enaddr}.
(Our|The|My) (tenant|office|plant|house|shop|new flat) (at|is at|is) {enaddr} (was|is|has been) {enverb}.
{ensentence} {enaddr}(, {place}|).
(Ring|Knock|Stop|Park|Turn left|Collect the {enoun}) (at|from|near) {enaddr}( and ask for {name}|).
(Spendenkonto|Kontoinhaber|Konto von|Mieter|Kunde) {name}, {ikey} {id}
{name}, {ikey} {id}, (ist|wird|war) {adverb} {part}.
{ikey} {id}, {noun} {noun}.
(Der Kunde|Die Kundin|Der Mieter|Frau|Herr|Zeuge) {name}, {addr}, {verb} {np}.
{name} <{email}> (schrieb|wrote|meldet|antwortet)( am {date}| {adverb}|)(:|.)
the {enoun} belongs to {entitle}{name}, {enaddr}{entown}.
"""

NEGATIVE = r"""
{sentence}
{sentence} {sentence}
{sentence}\n{sentence}
{sentence} {sentence} {sentence}
{sentence} {ensentence}
{ensentence}
{ensentence} {ensentence}
- {noun}: {num} {unit}\n- {noun}: {num} {unit}\n- {noun}: {num} {unit}
- {noun}\n- {noun}\n* {noun}
{noun}: {num} {unit}
{noun} {noun} ({code})
{noun} {code}\n{noun}
{noun}: {noun}
{noun};{noun};{noun}\n{noun};{num};{num} {unit}
{noun}, {noun} und {noun} sind {part}.
{noun} / {noun}: {noun}, {noun}
(Das|Ein|Jedes) {thing}-{noun} (ist|wird|wurde) {adverb} {part}.
(Der|Ein|Dieser) {thing}-{noun} {verb} {np} mit {num} {unit}.
(Die|Eine|Diese) {thing}-{thing}-{noun} (gilt|ist|wird) {adverb} {part}.
(Nach|Laut|Gemäß) (dem|der) {thing}-{thing}-{noun} (gilt|ist|war) {np} {part}.
(Das|Im|Am) {thing}-{thing}-(Institut|Gymnasium|Haus|Stadion|Museum|Verfahren|Modell) {verb} {np}.
(Projekt|Modell|Typ|Sturmtief|Orkan|Baureihe|Variante|Werkzeug|Roboter|Prüfling|Server|Programm|Aktion) {thing} (ist|wird|startet|endet|beginnt|folgt|entfällt) {adverb}(, der {noun} {thing} (folgt|endet|beginnt) später|).
(Das Projekt|Das Schiff|Die Fähre|Der Kran|Der Rechner|Der Stand|Die Halle|Die Anlage) {thing} (ist|wird|bleibt|liegt) {adverb} {part}.
(Der|Die|Das) {noun} \({word} {thing}\) (ist|wird|bleibt) {part}.
(Die|Der) Firma {thing} (GmbH|AG|KG|& Co.) {verb} {np}.
(Die|Eine|Jede|Keine|Diese) {thing} (ist|wird|hat|verliert|bleibt|bricht) {adverb} {part}.
(Der|Ein|Jeder|Kein|Dieser) {thing} (ist|wird|hat|verliert|bleibt|kommt) {adverb} {part}.
(Im|Am|Vom|Zum|Beim) {thing} (ist|wird|war|gilt|bleibt) {np} {part}.
({thing}|Sommer|Montag|Tag) (und|wie|oder) ({thing}|Winter|Dienstag|Nacht) (ist|sind|gilt|bleiben) {np} {part}.
(Die|Diese|Jede) {noun}(straße|allee|gasse|platz|wall) (der|auf der|neben der) {noun} ist {num} (mm|cm|m) (breit|lang|hoch).
(Im|Am|Zum|Zur|In der|An der) (Raum|Gleis|Tor|Abschnitt|Kapitel|Punkt|Stand|Seite|Anlage|Zeile|Stelle|Stichtag|Lager|Tag|Montag|Jahr|Halle|Ebene|Position|Stufe|Kanal) {num3} {verb} {np}.
(Siehe|Vergleiche|Gemäß) (Seite|Abschnitt|Kapitel|Anlage|Bild|Tabelle|Blatt) {num3}(, (Seite|Abschnitt|Blatt) {num3} (von|bis) {num3}|).
(Auflage|Ausgabe|Version|Stand|Fassung|Firmware|Software|Build|Treiber) {version}( vom {date}|)(, (Hash|Summe|Prüfwert|Kennwert) {hex}|).
{num3} (Ringe|Teile|Stück|Kisten|Hefte) (liegen|fehlen) (im|am|beim) {noun}, {noun} {num3}.
(Artikelnummer|Seriennummer|Bestellnummer|Chargennummer|Auftragsnummer|Zeichnungsnummer|Losnummer|Teilenummer|Sachnummer|Materialnummer|Inventarnummer|Messreihe|Charge|Zeichnung|Artikel|Auftrag|Los|Versuchsreihe|Protokoll|Dokument|Akte)( Nr.|:|) {series}(, (Blatt|Seite|Los|Lage) {num3}( von {num3}|)|)( (ist|wird|bleibt|wurde) {part}| fehlt| liegt vor|)(.|)
(Der|Das|Die) {noun} (mit der|hat die|trägt die|ohne) (Nummer|Kennung|Marke|Aufschrift) {series} (ist|wird|bleibt) {part}.
(Rechner|Server|Drucker|Router|Kamera|Anschluss|Knoten) (unter|mit|auf) {ip}(, (Port|Kanal|Platz) {num3}|)( antwortet|).
@{noun}(max={num3})? (setzen|prüfen|eintragen), {noun}@{noun} (lesen|löschen).
{noun} {num3}@{num3}{unit}, {noun} @{word}
(Konto|Buchung auf|Zahlung an|Lastschrift von) {like} (wurde|ist|wird) (abgelehnt|gesperrt|ungültig|falsch|gelöscht).
({noun}|Marke|Aufschrift|Kennung|Bauteil) {code2} (liegt|steht|fehlt|ist {part}).
(Tel|Telefon|Fax|Mail|Adresse|Ausweis|Name)(:|) (fehlt|unbekannt|keine Angabe|siehe Anlage|-)
(Straße|Weg|Platz|Name|Herr|Frau|Doktor|Kollege) (ist|wird|und|oder) {noun} {part}.
(Sehr geehrte Damen und Herren|Liebe Kolleginnen und Kollegen|Hallo zusammen|Guten Morgen|Liebe Mitglieder),\n{sentence}
{closing}\nIhr(e|) (Team|Verwaltung|Werkstatt|Abteilung {noun}|Hausverwaltung)
(Die|Der) (Kollegen|Kunde|Kollege|Prüfer|Leiter|Lehrer|Arzt|Betreiber|Fahrer|Hersteller|Lieferant) (hat|haben|wird|muss|bestätigt|verlangt|entscheidet über) {np}( {part}|, dass {np} {part} ist|).
(Vor|Nach|Während|Bei|Wegen|Trotz|Ohne|Für) (der|dem|des|die) {noun} (hat|ist|wird|bleibt) {np} {part}.
{noun} (nach|gemäß|laut|zu|aus) (DIN|ISO|EN|IEC|VDI|HN|WN|UN|LH|SY|PRF|EMV)[ -]?{num3}(-{digit}|.{digit}.{digit}|) (ist|wird) {part}.
(DIN|ISO|EN|VDI|LH|SY|PRF|EMV|RL)[ -]{digit}.{num3}.{digit} \[(MUSS|KANN|SOLL|MUST|SHALL|INFO)\] {sentence}
(Das|Im) (Handbuch|Heft|Blatt|Verfahren|Gerät|Modell|Papier) {made} {letter}{num3} (nennt|verlangt|gilt für|ersetzt) {np}.
(Wer|Was) nach {made}\n{letter}{num3}\n(arbeitet|misst), (muss|soll|darf) {np} (prüfen|lesen|beachten).
(Anders als|Im Gegensatz zu|Neben|Ohne) {made} {letter}{num3} (ist|gilt|wird) {np} {part}.
(Das|Der|Die) {made}-{noun} {verb} {np}.
(In|Aus|Bei|Nach|Um|Über|Für|Durch) (Österreich|Deutschland|Europa|Asien|Norwegen|Bayern|Sachsen|Frankreich|Polen) (ist|wird|gilt|liegt) {np} {part}.
(In|Aus|Bei|Nach|Um|Über) {place} (ist|wird|war|liegt) {np} {part}.
({place}|{place}er {noun}|Die Stadt {place}) (ist|wird|war|liegt|hat) {adverb} {part}.
(Am|Seit|Bis|Vor|Ab) {date} (ist|wird|bleibt|war) {np} {part}.
½ ⅔ ² ³ µ Ω {noun} ({letter}{digit}) → {num} {unit}
{NOUN} {NOUN}\n{sentence}
{noun} {noun}
{noun}
{noun} {noun}\n\n{sentence}
{num} {noun}\n{sentence}
{salad}
{salad} {salad}
{foreign}
{foreign}\n{sentence}
{sentence} {foreign}
{NOUN}: {sentence}
(Alle|Beide|Manche|Viele|Einige|Mehrere|Solche|Andere|Welche|Sämtliche) {noun} (zu|an|in|bei|für|aus|der|des) {np} (sind|werden|gelten|bleiben) {part}.
{sentence} (Alle|Beide|Manche|Viele|Einige|Mehrere|Solche|Andere|Welche|Sämtliche) {noun} (zu|an|in|bei|für|aus|der|des) {np} {verb} {noun}.
{noun} {noun} ({code})\n\n{sentence}
{sentence}\n\n{noun} {noun} ({code})\n{sentence}
{sentence}\n{noun} {noun} {code}\n\n{sentence}
{noun} der {noun} ({letter}{letter} {digit}.{digit}.{digit})
The {enoun} and the {enoun} are {enverb} (together|at {num} {enunit}|in winter|during charging|within {num} {enunit}).
(In|On|For|By|Under|Since) (May|Monday|Friday|October|Germany|London|Europe|winter|summer) the {enoun} (was|is|shall be) {enverb}.
(The|Every|No|This) {enoun} (must|may|shall|should) (only |not |)(exceed|need|carry|show) {num} {enunit}( in {EnNoun} mode| for the {EnNoun} Group|).
{EnNoun} {EnNoun} (Report|Guide|Manual|Notes) {num3}
({thing}|{EnNoun}) (Tower|Bridge|University|Institute|Award|Foundation|Engine|Method) (is|was) {enverb}.
(According to|See|Under) (ISO|EN|HN|SY|Section|Table|Part|Page) {num3}(-{digit}|.{digit}|) the {enoun} (is|was) {enverb}.
(Model|Project|Storm|Version|Type|Unit|Drive|Batch|Serial number|Part number|Drawing) ({thing}|{series}) (is|was) {enverb}.
(A|The) gap of {num} {enunit} (is|was) kept between the {enoun} and the {enoun}.
"""

_ALT, _PLACE = re.compile(r"\(([^()]*)\)(?!\?)|\(([^()]*)\)\?"), re.compile(r"\{([A-Za-z]\w*)\}(\?)?")
_MARKED = {"name": "name", "revname": "name", "surname": "name", "first": "name", "addr": "address", "enaddr": "address", "phone": "phone", "email": "email", "id": "id_number"}


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def made_family(r: random.Random) -> str:
    return r.choice(_HEADS) + r.choice(_MIDS) + r.choice(_TAILS)


class _Maker:
    """Fills places; ``given`` and ``family`` are the listed names."""

    def __init__(self, given: list[str], family: list[str], r: random.Random):
        self.given, self.family, self.r = given, family, r
        self.people = 0.0  # the share of names among the parts of a sentence

    def first(self) -> str:
        r, kind = self.r, self.r.random()
        if self.given and kind < 0.3:
            out = r.choice(self.given)
        elif kind < 0.75:
            out = r.choice(GIVEN)
        else:
            out = r.choice(_GIVEN_HEADS) + r.choice(_GIVEN_TAILS)
        return out + "-" + r.choice(GIVEN) if r.random() < 0.1 else out

    def surname(self) -> str:
        r, kind = self.r, self.r.random()
        if self.family and kind < 0.25:
            out = r.choice(self.family)
        else:
            out = r.choice(FAMILY) if kind < 0.45 else made_family(r)
        if r.random() < 0.2:
            out += "-" + (r.choice(FAMILY) if r.random() < 0.5 else made_family(r))
        return r.choice(["van ", "von ", "de ", "zu ", "van der ", "von der "]) + out if r.random() < 0.06 else out

    def name(self, titled: bool, listed: bool = False) -> str:
        r, kind = self.r, self.r.random()
        first, last = self.first(), self.surname()
        if titled and kind < 0.6 or kind < 0.07:
            text = last
        elif kind < 0.7:
            text = f"{first} {last}" if r.random() < 0.9 else f"{first} {r.choice(GIVEN)} {last}"
        elif kind < 0.84:
            text = f"{first[0]}. {last}" if r.random() < 0.85 else f"{first[0]}. {r.choice('ABCEGHJKMS')}. {last}"
        elif not titled and not listed and kind < 0.94:
            text = f"{last}, {first}" if r.random() < 0.8 else f"{last}, {first[0]}."
        else:
            text = f"{first} {last}"
        return text.upper() if r.random() < 0.08 else text

    def revname(self) -> str:
        return f"{self.surname()}, {self.first()}"

    def phone(self) -> str:
        r = self.r
        area, rest, end = r.choice(["30", "40", "69", "89", "221", "711", "521", "5132", "173", "160", "7071"]), _digits(r, r.choice([3, 4, 5])), _digits(r, r.choice([2, 3]))
        return r.choice([
            f"0{area} {rest}{end}", f"0{area}/{rest}-{end}", f"0{area} / {rest}{end}", f"(0{area}) {rest} {end}", f"0{area} - {rest} - {end}", f"0{area}.{rest}.{end}", f"+49 {area} {rest} {end}", f"+49{area}{rest}{end}", f"0{area}-{rest}{end}",
            f"+49 (0){area} {rest}-{end}", f"0049 {area} {rest}{end}", f"0{area}{rest}{end}", f"+44 20 {_digits(r, 4)} {_digits(r, 4)}", f"020 {_digits(r, 4)} {_digits(r, 4)}", f"+49-{area}-{rest}-{end}", f"0{area} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}",
            f"({r.choice('23456789')}{_digits(r, 2)}) 555-0{end[:2]}{r.randint(0, 9)}", f"+1 212-555-0{end[:2]}7", f"+44 (0)20 {_digits(r, 4)} {_digits(r, 4)}", f"+43 1 {rest}{end}", f"+41 44 {_digits(r, 3)} {_digits(r, 2)} {_digits(r, 2)}",
        ])

    def email(self) -> str:
        r = self.r
        last, first = (self.surname().split()[-1].lower().translate({228: "ae", 246: "oe", 252: "ue", 223: "ss", 39: None}) for _ in range(2))
        local = r.choice(["{1}.{0}", "{0}", "{2}.{0}", "{2}{0}", "{0}+test", "{1}_{0}", "{0}-{1}", "{0}" + _digits(r, 2), "box", "box"]).format(last, first, first[0])
        local = r.choice(_BOXES) if local == "box" else local
        dot, at = r.choice([(".", "@")] * 7 + [(".", " @ "), (".", " (at) "), ("[punkt]", "[at]"), (" (dot) ", " (at) "), (".", "[at]")])
        text = local.replace(".", dot if dot != " (dot) " else ".") + at + r.choice(_HOSTS).replace(".", dot)
        return text.upper() if r.random() < 0.06 else text

    def id(self, right: bool = True) -> str:
        r = self.r
        kind = r.random()
        while True:
            if kind < 0.3:
                body = "DE" + _digits(r, 20) if r.random() < 0.8 else r.choice(["AT", "NL", "GB", "FR", "CH"]) + _digits(r, 18)
                text = next((body[:2] + f"{k:02}" + body[4:] for k in range(98) if iban_check(body[:2] + f"{k:02}" + body[4:])), body)
                shown = " ".join(re.findall(".{1,4}", text)) if r.random() < 0.6 else text
                ok = iban_check(text)
            elif kind < 0.55:
                text = _digits(r, 11)
                shown, ok = f"{text[:2]} {text[2:5]} {text[5:8]} {text[8:]}" if r.random() < 0.6 else text, tax_check(text)
            elif kind < 0.75:
                text = _digits(r, 2) + f"{r.randint(1, 28):02}{r.randint(1, 12):02}{r.randint(0, 99):02}" + r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + _digits(r, 3)
                shown, ok = f"{text[:2]} {text[2:8]} {text[8]} {text[9:]}" if r.random() < 0.6 else text, insurance_check(text)
            else:
                text = r.choice("LMPRTWYZC") + "".join(r.choices("0123456789CFGHJKLMNPRTVWXYZ", k=8)) + _digits(r, 1)
                shown, ok = text, card_check(text)
            if ok == right:
                return shown
            if not right and kind < 0.3:
                wrong = text[:-1] + str((int(text[-1]) + 1) % 10)
                return " ".join(re.findall(".{1,4}", wrong)) if r.random() < 0.5 else wrong

    def addr(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.55:
            street = r.choice(_STREET_HEADS) + r.choice(_STREET_TAILS)
        elif kind < 0.65:
            street = self.town().split()[-1] + r.choice(["er Straße", "er Str.", "er Weg", "er Ring", "er Allee", "er Chaussee"])
        elif kind < 0.75:
            street = f"{r.choice(GIVEN)}-{self.surname().split()[-1]}-{r.choice(['Straße', 'Str.', 'Weg', 'Allee', 'Platz', 'Ring'])}"
        elif kind < 0.88:
            what = r.choice([r.choice(_PLACES).capitalize(), r.choice(_STREET_HEADS) + r.choice(_PLACES), "Alten " + r.choice(_PLACES).capitalize()])
            street = f"{r.choice(['Am', 'Zum', 'Zur', 'An der', 'An den', 'Im', 'In der', 'Hinter dem', 'Hinter der', 'Hinter den', 'Vor dem', 'Auf dem', 'Auf der', 'Unter den', 'Beim'])} {what}"
        else:
            street = r.choice(_STREET_WHOLE)
        return f"{street} {r.randint(1, 180)}{r.choice(['', '', '', 'a', 'c', ' b'])}"

    def enaddr(self) -> str:
        r = self.r
        return f"{r.randint(1, 190)}{r.choice(['', '', '', 'a'])} {r.choice(_EN_STREETS) if r.random() < 0.6 else r.choice(FAMILY) if r.random() < 0.6 else made_family(r)} {r.choice(_EN_TAILS)}"

    def town(self) -> str:
        r = self.r
        return r.choice(_TOWNS) if r.random() < 0.4 else r.choice(_TOWN_PARTS[0]) + r.choice(_TOWN_PARTS[1])

    def noun(self) -> str:
        r, kind = self.r, self.r.random()
        if kind > 0.96:
            return "".join(r.choices("ABCDEGHKLMNPRSTUV", k=r.randint(2, 4))) + r.choice(["-" + self.noun(), "-" + self.noun(), ""])
        if kind < 0.35:
            return r.choice(r.choice((_THINGS, _EVERYDAY, _TOOLS)))
        if kind < 0.5:
            return r.choice(_ABSTRACT)
        if kind < 0.72:
            return r.choice(_NOUN_HEADS) + r.choice(_NOUN_TAILS)
        if kind > 0.82:
            head = r.choice(_NOUN_HEADS + _TOOLS) if r.random() < 0.6 else r.choice(_THINGS + _ABSTRACT + _EVERYDAY) + r.choice(["s", "en", ""])
            return head + r.choice(_THINGS + _ABSTRACT + _EVERYDAY + _TOOLS).lower()
        return r.choice(_STEMS) + r.choice(["ung", "ung", "heit", "keit", "er", "tion", "schaft", "en", "e", "nis"])

    def adjective(self) -> str:
        r = self.r
        return r.choice([r.choice(_ADJ) + r.choice(["e", "er", "es", "en", "em"]), r.choice(_PARTS) + r.choice(["e", "er", "es", "en"]), r.choice(["zwei", "drei", "zwölf", "viel", "wenig", "mehr"])])

    def np(self) -> str:
        r = self.r
        if self.people and r.random() < self.people:
            return r.choice(["{title}{name}"] * 6 + ["{first}", "{surname}"])
        adj = f"{r.choice(_ADJ if r.random() < 0.5 else _PARTS)}e " if r.random() < 0.35 else ""
        if r.random() < 0.06:  # a thing called after someone
            return f"{r.choice(['der', 'die', 'das', 'ein', 'dem', 'den', 'des'])} {self.thing()}-{r.choice([self.thing() + '-', '', '', ''])}{self.noun()}"
        return f"{r.choice(['der', 'die', 'das', 'ein', 'eine', 'jede', 'kein', 'unser', 'diese'])} {adj}{self.noun()}"

    def sentence(self) -> str:
        r, np = self.r, self.np
        low = r.choice([
            lambda: f"{np()} {r.choice(_VERBS)} {np()} {r.choice(_ADVERBS)}", lambda: f"{np()} wird {r.choice(_ADVERBS)} {r.choice(_PARTS)}", lambda: f"{r.choice(_ADVERBS)} wurde {np()} {r.choice(_PARTS)}",
            lambda: f"{np()} und {np()} werden {r.choice(_ADVERBS)} {r.choice(_PARTS)}", lambda: f"{r.choice(['nach', 'vor', 'bei', 'für', 'wegen', 'mit', 'während'])} der {self.noun()} ist {np()} {r.choice(_PARTS)}",
            lambda: f"{r.choice(['wenn', 'sobald', 'falls', 'weil'])} {np()} {r.choice(_PARTS)} ist, {r.choice(_VERBS)} {np()}", lambda: f"{r.choice(['wenn', 'bis', 'weil', 'da', 'falls'])} {np()} {self.number()} {r.choice(_UNITS)} {r.choice(['wiegt', 'misst', 'kostet', 'braucht', 'zeigt', 'erreicht'])}, {r.choice(_VERBS)} {np()} {self.noun()}",
            lambda: f"{np()} darf höchstens {self.number()} {r.choice(_UNITS)} {r.choice(['haben', 'wiegen', 'kosten', 'aufnehmen'])}",
            lambda: f"{np()} {r.choice(_VERBS)} {self.noun()} und {self.noun()}", lambda: f"{r.choice(['wer', 'was'])} {np()} {r.choice(_VERBS)}, {r.choice(_VERBS)} {np()}", lambda: f"{r.choice(_ADVERBS)} {r.choice(_VERBS)} {np()} {np()}", lambda: f"{np()} {r.choice(_DOES)} {r.choice(_ADVERBS)} {r.choice(['mit', 'bei', 'für', 'von', 'um', 'an', 'ohne', 'auf'])} {np()}",
            lambda: f"{r.choice(['als', 'dass', 'ob', 'seit', 'weil', 'was', 'wie', 'bevor'])} {np()} {np()} {r.choice(_PARTS)}, {r.choice(_DOES)} {np()}", lambda: f"{r.choice(['der', 'die', 'unser', 'mein', 'ihr', ''])} {self.profession()} {np()} {r.choice(_DOES)} {np()}", lambda: f"{np()}, {r.randint(18, 80)}, {r.choice(_DOES)} {r.choice(_ADVERBS)} {np()}",
            lambda: f"{r.choice(['ohne', 'mit', 'von', 'bei', 'für', 'gegen', 'um', 'seit', 'durch'])} {np()} {r.choice(_DOES)} {np()} {r.choice(_ADVERBS)}", lambda: f"{np()} {r.choice(_DOES)}, {np()} {r.choice(_DOES)} {r.choice(_ADVERBS)}", lambda: f"{r.choice(_ADVERBS)} {r.choice(_DOES)} {r.choice(['', 'auch ', 'nur ', 'diesmal ', 'sich '])}{np()}",
            lambda: f"{np()} {r.choice(['gehört', 'hilft', 'fehlt', 'gefällt', 'verspricht'])} {np()}, {r.choice(['nicht', 'aber', 'sondern'])} {np()}", lambda: f"{np()} {r.choice(['ist', 'war', 'wurde', 'heißt', 'hieß'])} {np()}",
            lambda: f"{np()} {r.choice(['am', 'im', 'beim', 'zum'])} {self.noun()} {r.choice(_VERBS)} mit {self.number()} {r.choice(_UNITS)}", lambda: f"{self.noun()} für {np()} {r.choice(_VERBS)} {np()}",
            lambda: f"{np()} {r.choice(['gilt', 'erfolgt', 'dauert', 'bleibt', 'misst'])} {r.choice(['bei', 'mit', 'ohne', 'nach', 'vor', 'insbesondere', 'unter'])} {self.adjective()} {self.noun()}{r.choice(['', ' und ' + self.noun()])}",
            lambda: f"{r.choice(['bei', 'zur', 'zum', 'vor', 'nach', 'für', 'mit', 'im', 'am', 'zwischen', 'neben', 'hinter', 'gegenüber', 'entlang', 'außer', 'anhand', 'mittels', 'innerhalb'])} {r.choice(['', 'der ', 'dem ', 'einer '])}{self.noun()} {r.choice(['', 'und dem ' + self.noun() + ' '])}{r.choice(_VERBS)} {np()} und {r.choice(['das ', 'der ', ''])}{self.noun()}",
            lambda: f"{np()} {r.choice(_VERBS)} {self.number()} {r.choice(_UNITS)}. {self.noun()} für {np()} {r.choice(_VERBS)} {self.noun()}", lambda: f"{self.adjective()} {self.noun()} {r.choice(_VERBS)} {self.adjective()} {self.noun()} {r.choice(_ADVERBS)}",
            lambda: f"{r.choice(['treten', 'liegen', 'entstehen', 'gibt es', 'sind', 'bleiben'])} {r.choice(['an', 'bei', 'in', 'auf', 'unter'])} {np()} {self.noun()} {r.choice(['auf', 'vor', 'an', 'ein', _PARTS[0]])}, {r.choice(_DOES)} {np()}", lambda: f"{np()} {r.choice(_VERBS)} {r.choice(['bei', 'ohne', 'mit', 'unter', 'aus', 'wegen'])} {self.noun()} {r.choice(['und ' + self.noun() + ' ', ''])}{r.choice(_ADVERBS)}",
            lambda: f"{np()} der {self.noun()} liegt bei {self.number()} {r.choice(_UNITS)}", lambda: f"{np()}, {r.choice(['die', 'der', 'das'])} {r.choice(_ADVERBS)} {r.choice(_PARTS)} ist, {r.choice(_VERBS)} {self.noun()} nach {self.noun()}",
        ])()
        return low[0].upper() + low[1:] + r.choice("....!?")

    def profession(self) -> str:
        r = self.r
        return r.choice(_KIN) if r.random() < 0.3 else r.choice(_PROFESSIONS) + r.choice(["", "in"])

    def ensentence(self) -> str:
        r = self.r
        np = lambda: r.choice(["{entitle}{name}"] * 4 + ["{first}"]) if r.random() < self.people else f"{r.choice(['the', 'a', 'each', 'our', 'this', 'no'])} {r.choice([r.choice(_EN_ADJ) + ' ', ''])}{r.choice(_EN_THINGS)}"
        low = r.choice([
            lambda: f"{np()} was {r.choice(_EN_VERBS)} by {np()}", lambda: f"{np()} and {np()} are {r.choice(_EN_VERBS)} before {np()}", lambda: f"if {np()} is {r.choice(_EN_VERBS)}, {np()} must be {r.choice(_EN_VERBS)}",
            lambda: f"{np()} {r.choice(_EN_DOES)} {np()} {r.choice(['before', 'after', 'at', 'for', 'with', 'about', 'near', 'that'])} {np()}", lambda: f"{r.choice(['when', 'because', 'after', 'nobody told', 'we saw', 'they met', 'my'])} {np()} {r.choice(_EN_DOES)} {np()}",
            lambda: f"{r.choice(['my', 'our', 'the', 'your'])} {r.choice(_EN_PROFESSIONS)} {np()} {r.choice(_EN_DOES)} {r.choice(_EN_VERBS)} {np()}", lambda: f"{np()}, {r.randint(18, 80)}, {r.choice(_EN_DOES)} {np()}", lambda: f"{np()} and {np()} {r.choice(_EN_DOES)} {np()}",
            lambda: f"{r.choice(_EN_THINGS).capitalize()}{r.choice(['s', ''])} {r.choice(['of', 'for', 'in', 'from', 'with', 'and', 'parts for'])} {np()} {r.choice(['are', 'is', 'were', 'must be', 'follow'])} {r.choice(_EN_VERBS)}", lambda: f"{r.choice(_EN_ADJ).capitalize()} {r.choice(_EN_THINGS)}s {r.choice(_EN_DOES)} {np()}",
            lambda: f"{np()} {r.choice(['was', 'is', 'shall be'])} {r.choice(_EN_VERBS)} {r.choice(['without load', 'at maximum speed', 'in the cold', 'under full load', 'by hand'])}. {r.choice(_EN_THINGS).capitalize()}{r.choice(['s', ''])} {r.choice(['of', 'for'])} {np()} {r.choice(_EN_DOES)}",
            lambda: f"{np()} takes {self.number()} {r.choice(_EN_UNITS)} in {r.choice(['summer', 'May', 'wet conditions', 'London', 'test mode'])}", lambda: f"we {r.choice(_EN_VERBS)} {np()} on {r.choice(['Monday', 'Friday', 'time', 'site'])}",
        ])()
        return low[0].upper() + low[1:] + "."

    def number(self) -> str:
        r = self.r
        return r.choice([str(r.randint(1, 2999)), f"{r.randint(0, 60)},{r.randint(0, 9)}"])

    def thing(self) -> str:
        """A listed or common name that here isn't a person's."""
        r = self.r
        listed = self.given + self.family
        return r.choice(listed) if listed and r.random() < 0.7 else r.choice(GIVEN + FAMILY) if r.random() < 0.8 else made_family(r)

    def series(self) -> str:
        r = self.r
        return r.choice([
            f"0{_digits(r, 3)} {_digits(r, 5)} {_digits(r, 4)}", f"0{_digits(r, 2)}-{_digits(r, 5)}/{_digits(r, 1)}", f"0{_digits(r, 9)}", f"{_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 2)}.{_digits(r, 4)}.{_digits(r, 3)}", f"0{_digits(r, 1)}{_digits(r, 5)}{_digits(r, 4)}",
            f"0{_digits(r, 2)}/{_digits(r, 6)}", f"00{_digits(r, 8)}", f"0{_digits(r, 3)}-{_digits(r, 4)}", _digits(r, r.randint(5, 12)),
        ])

    def fill(self, kind: str, titled: bool) -> str:
        r = self.r
        pick = r.choice
        if kind in ("phone", "email", "id", "addr", "enaddr", "sentence", "ensentence", "noun", "np", "thing", "series", "first", "surname", "revname"):
            return getattr(self, kind)()
        return {
            "town": lambda: pick(["", "", ", {} {}", "\n{} {}", ", D-{} {}", " in {1}", ", {1}"]).format(_digits(r, 5), self.town()), "town1": lambda: pick(["", ", {} {}"]).format(_digits(r, 5), self.town()), "entown": lambda: pick(["", "", ", {}", ", {} AB1 2CD", ", {} ZZ4 3QX"]).format(self.town()),
            "place": self.town, "prof": self.profession, "inaddr": lambda: pick(["in der ", "", "im ", "am ", "in "]), "num": self.number, "num3": lambda: str(r.randint(1, 999)), "digit": lambda: str(r.randint(0, 30)), "letter": lambda: pick("ABCDEFGHKLMNPRSTUVWXZ"),
            "verb": lambda: pick(_VERBS), "part": lambda: pick(_PARTS), "adverb": lambda: pick(_ADVERBS), "adj": lambda: pick(_ADJ), "unit": lambda: pick(_UNITS), "enunit": lambda: pick(_EN_UNITS), "enverb": lambda: pick(_EN_VERBS), "enoun": lambda: pick(_EN_THINGS), "EnNoun": lambda: pick(_EN_THINGS).title(),
            "salad": lambda: " ".join(pick([self.noun, self.adjective, lambda: pick(_VERBS), lambda: pick(_ADVERBS), self.number, lambda: pick(_UNITS), lambda: self.fill("made", False), lambda: self.fill("code", False), lambda: pick(["der", "und", "für", "ist", "wenn", "-", ",", "nicht", "the"])])() for _ in range(r.randint(6, 24))),
            "foreign": lambda: " ".join("".join(r.choices(alphabet, k=r.randint(3, 9))).capitalize() if r.random() < 0.5 else "".join(r.choices(alphabet, k=r.randint(2, 9))) for alphabet in [pick(["абвгдежзиклмнопрстуя", "αβγδεζηθικλμνοπρστυω", "ابتثجحخدذرزسشصض", "検査完了部品温度圧力"])] for _ in range(r.randint(1, 4))),
            "NOUN": lambda: self.noun().upper(), "word": lambda: pick(_ADVERBS + ["Typ", "Bauart", "Marke", "Serie", "siehe", "Stand"]), "made": lambda: made_family(r) if r.random() < 0.7 else pick(_GIVEN_HEADS) + pick(_GIVEN_TAILS), "date": lambda: pick(["{}.{}.{}", "{:02}.{:02}.{}"]).format(r.randint(1, 28), r.randint(1, 12), r.randint(1990, 2030)),
            "version": lambda: ".".join(str(r.randint(0, 120)) for _ in range(pick([2, 3, 4, 5]))), "hex": lambda: "".join(r.choices("0123456789abcdef", k=pick([8, 10, 12]))), "ip": lambda: ".".join(str(r.randint(1, 250)) for _ in range(4)),
            "code": lambda: pick(["{}{} {}.{}.{}", "{}{}-{}.{}.{}", "{}{} {}-{}"]).format(pick("LSPEHWD"), pick("HYRMN"), r.randint(1, 20), r.randint(1, 20), r.randint(1, 20)), "code2": lambda: pick(["Z" + "".join(r.choices("0123456789CFGHJKLMNPRTVWXYZ", k=8)) + "X", "SIG_" + _digits(r, 4), f"{_digits(r, 4)}-{_digits(r, 3)}", f"{_digits(r, 2)}-{_digits(r, 1)}-{_digits(r, 1)}"]),
            "like": lambda: self.id(False), "colon": lambda: pick(["", ":", " Nr."]), "role": lambda: pick("Leitung Prüfer Einkauf Vorstand Technik Sekretariat Engineer Manager Hausmeister".split()),
            "key": lambda: pick("Kontakt Kontaktperson Ansprechperson Betreuer Betreuerin Inhaber Sachbearbeitung Zuständig Prüfer Name Auftraggeber Vertreter Verantwortlich Leitung Empfänger Besteller Bearbeiter Unterzeichner Contact Owner".split()),
            "pkey": lambda: pick("Tel Tel. Telefon Mobil Handy Fax Fon Rufnummer Durchwahl Phone Notruf".split()), "mkey": lambda: pick("Mail E-Mail Email Mailadresse Kontakt Postfach Rückmeldung".split()), "akey": lambda: pick("Anschrift Adresse Lieferadresse Rechnungsadresse Wohnort Sitz Versand Absender Zustellung Standort".split()),
            "ikey": lambda: pick("IBAN|Steuer-ID|Steuernummer|Steuer-IdNr.|IdNr.|Bankverbindung|Konto|Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer|RVNR|Versicherungsnummer|Personalausweisnummer|Ausweis-Nr.|Passnummer|Ausweis|Kontonummer|Nr.".split("|")),
            "head1": lambda: pick("Name Person Mitglied Kunde Mitarbeiter Prüfer".split()), "head2": lambda: pick("Telefon Tel Mail Rufnummer Kontakt Mobil".split()), "head3": lambda: pick("Kennung Ausweis Konto Nummer ID".split()), "head4": lambda: pick("Adresse Anschrift Straße".split()),
            "jkey": lambda: pick("name person kunde kontakt inhaber author owner user mitarbeiter".split()), "jkey2": lambda: pick("mail email kontakt e-mail".split()), "jkey3": lambda: pick("tel phone telefon mobil".split()),
            "closing": lambda: pick(["Beste Grüße", "Viele Grüße", "Freundliche Grüße", "Mit besten Grüßen", "Herzliche Grüße", "Mit freundlichen Grüßen", "Mit freundlichem Gruß", "MfG", "Liebe Grüße", "Hochachtungsvoll", "Schöne Grüße,", "Gruß"]),
            "title": lambda: (pick(_TITLES) if r.random() < 0.8 else self.profession() + " ") if r.random() < 0.3 else "", "herr": lambda: pick(_TITLES[:8]), "entitle": lambda: pick(_EN_TITLES) if r.random() < 0.3 else "",
        }[kind]()


def _templates(block: str) -> list[str]:
    return [x.replace("\\n", "\n") for x in block.strip().split("\n")]


def _chosen(frame: str, r: random.Random) -> str:
    """One alternative of each group; a question mark after a group or place makes it optional. Escaped brackets stay."""
    frame = frame.replace("\\(", "\x01").replace("\\)", "\x02").replace("\\[", "\x03").replace("\\]", "\x04")
    frame = frame.replace("[ -]?", r.choice([" ", "-", ""])).replace("[ -]", r.choice([" ", "-"]))
    plain = {"({phone})": "\x01{phone}\x02", "({role})": "\x01{role}\x02", "({email})": "\x01{email}\x02", "({code})": "\x01{code}\x02", "({ikey}{colon} {id})": "\x01{ikey}{colon} {id}\x02", "({letter}{digit})": "\x01{letter}{digit}\x02", "({letter}{letter} {digit}.{digit}.{digit})": "\x01{letter}{letter} {digit}.{digit}.{digit}\x02", "(max={num3})": "\x01max={num3}\x02"}
    for a, b in plain.items():
        frame = frame.replace(a, b)
    while m := re.search(r"\(([^()]*)\)(\?(?=[\s,.({]|$))?", frame):
        taken = r.choice(m[1].split("|")) if not m[2] or r.random() < 0.5 else ""
        frame = frame[: m.start()] + taken + frame[m.end() :]
    frame = re.sub(r"([<>,]|\{\w+\})\?", lambda m: m[1] if r.random() < 0.5 else "", frame)
    return re.sub(r" {2,}", " ", frame).replace("\x01", "(").replace("\x02", ")").replace("\x03", "[").replace("\x04", "]")


def rows(given: list[str], families: list[str], n: int = ROWS, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]), two in three from POSITIVE."""
    r = random.Random(seed)
    make, lists, out = _Maker(given, families, r), [_templates(POSITIVE), _templates(NEGATIVE)], []
    for k in range(n):
        frames = lists[k % 3 == 2]
        template, text, marks, at, titled = _chosen(frames[r.randrange(len(frames))], r), "", [], 0, False
        template = template.replace("{sep}", r.choice([";", "; ", "\t", " | ", "|", ", "]))
        template = re.sub(r"\{(en)?names\}", lambda m: ", ".join([r.choice(["{title}{name}", "{name}", "{surname}", "{surname}", "{revname}", "{first}"]) for _ in range(r.randint(1, 5))]) + r.choice(["", "", " und {name}" if not m[1] else " and {name}"]), template)
        make.people = 0.45
        template = re.sub(r"\{(en)?nsent\}", lambda m: make.ensentence() if m[1] else make.sentence(), template)
        make.people = 0.0
        for m in _PLACE.finditer(template):
            text += template[at : m.start()]
            at, kind = m.end(), m[1]
            if kind in ("title", "entitle", "herr"):
                value = make.fill(kind, False)
                text, titled = text + value, bool(value)
                continue
            value = make.name(titled, "{name}, {name}" in template) if kind == "name" else make.fill(kind, titled)
            if kind in _MARKED:
                marks.append((len(text), len(text) + len(value), _MARKED[kind]))
                titled = False
            text += value
        text += template[at:]
        if r.random() < (0.12 if k % 3 == 2 else 0.03) and len(text.upper()) == len(text):
            text = text.upper()  # shouted
        out.append((text, marks))
    return out
