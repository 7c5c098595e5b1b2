"""Sentences written apart from the frames of ``labelled``: {n:name}, {a:address}, {p:phone}, {e:email} and {i} for a valid number."""

SENTENCES = """
Die Übergabe der Schlüssel erledigt {n:Annegret Vollmer} am Donnerstag.
Als {n:Bernd Rüther} das Werktor aufschloss, lag überall Schnee.
Nach dem Meeting rief mich {n:Dr. |Hilmar Quante} noch einmal zurück.
{n:Ludger Sassenberg} gewann den Prozess gegen seinen früheren Arbeitgeber.
Unser Lagerist {n:Zbigniew Pawlak} spricht vier Sprachen.
Den zweiten Platz belegte überraschend {n:Mareike Thoms} aus Wismar.
Ob {n:Herr |Bökenkamp} den Vertrag verlängert, ist noch offen.
Sie können die Unterlagen bei {n:Frau |Schimanski} im dritten Stock einsehen.
{n:Gundula Wischnewski} und {n:Ortwin Hebestreit} heirateten 1987 in Stralsund.
Das Gutachten wurde von {n:Prof. |Ekkehard Nolting} verfasst.
Wir trauern um unseren langjährigen Mitarbeiter {n:Eberhard Pieper}.
Zum neuen Abteilungsleiter wurde {n:Nuri Karaca} ernannt.
Der Anwalt der Klägerin, {n:Volkmar Strothmann}, legte Berufung ein.
Kurz vor Feierabend kam {n:Kollege |Hinrichsen} mit der defekten Pumpe vorbei.
Dass {n:Isolde Marquardt} fehlt, fiel erst am Abend auf.
Im Tor stand diesmal {n:Yannick Bödeker}.
Der Dank gilt vor allem {n:Friederike Uhlenbrock} und ihrem Team.
{n:Fr. |Tiedemann} bittet um Rückruf unter {p:0421 5587312}.
Der Schlosser {n:Detlef Knaup} reparierte das Geländer in zwei Stunden.
Mit {n:Sigrid Harmsen} habe ich seit Jahren nichts mehr zu tun.
Hat {n:Jolanta} dir das Protokoll schon geschickt?
Bitte grüßen Sie {n:Herrn |Everding} von mir.
Meine Nachbarin {n:Rosemarie Plaschke} gießt die Blumen.
Das Fahrrad gehört {n:Timo Reckzeh}, nicht der Schule.
Gestern Abend erklärte {n:Ministerin |Gesine Althoff} ihren Rücktritt.
Am Flügel begleitete sie {n:Arkadi Silbermann}.
{n:Niklas Ehrhorn}, 34, wurde leicht verletzt ins Krankenhaus gebracht.
Der Vorarbeiter hieß {n:Heinz-Peter Lohoff} und kam aus Unna.
Was {n:Mathilde von Rabenau} damals schrieb, gilt bis heute.
Die Skizze trägt die Unterschrift von {n:J. Wesselmann}.
Laut {n:Karl-Heinz Deppe} fehlen noch zwei Kisten.
Ansprechbar ist dafür nur noch {n:Frau Dr. |Ilgner}.
Die Vertretung übernimmt {n:Melek Şahin}.
{n:Wagenknecht, Ruth}: Die Heizung ist ausgefallen.
Angemeldet haben sich bisher {n:Pohlmann}, {n:Stratmann} und {n:Ückert}.
Der Versicherte {n:Torben Jacobi} meldete den Schaden verspätet.
Ohne {n:Swantje Focken} hätten wir das nie geschafft.
Von {n:Elfriede Zumbusch} stammt auch das Rezept.
Da lachte {n:Onkel |Alfons} und schenkte Kaffee nach.
Fotografiert hat {n:Lioba Staudinger}, gesetzt hat {n:Rolf Emde}.
Seit {n:Piet Hogeveen} im Ruhestand ist, steht die Maschine still.
Der Brief war an {n:Eheleute |Wiegand} gerichtet.
{n:H. Brockhage} bestätigt den Eingang von 40 Kisten.
Das Team um {n:Leonie Fassbender} misst jeden Morgen die Temperatur.
Für die Wartung ist künftig {n:Meister |Ochsenfarth} zuständig.
Nachgefragt bei {n:Hubertus Klie}: Die Welle wurde getauscht.
Die Polizei sucht nach dem Zeugen {n:Ramazan Gündüz}.
Dann übergab {n:Schwester |Bernadette} die Station.
Vertreten wird die GmbH durch {n:Clemens Rottmann}.
Den Schaden schätzt {n:Sachverständiger |Uwe Pietsch} auf 4000 Euro.
Prüfer war {n:W. Hellweg}, Gegenprüfer {n:T. Osing}.
Im Auftrag von {n:Constanze Biermann} haben wir das Dach vermessen.
{n:Ayşe Yavuz} betreut die Prüfstände 3 bis 7.
Gemessen hat {n:Bartholomäus Kling}, ausgewertet wurde später.
Die Zeichnung kommt von {n:Frau |Lüdeking-Haas}.
Sehr geehrte Frau {n:Nottebohm}, anbei die Rechnung.
Hallo {n:Gesa}, der Termin passt mir gut.
Lieber Herr {n:Wittkowski}, vielen Dank für Ihre Geduld.
Moin {n:Fiete}, kommst du morgen mit?
Sehr geehrter Herr Dr. {n:Salzmann}, wir bestätigen den Termin.
Viele liebe Grüße aus Emden, {n:Wiebke}
Es grüßt Sie herzlich\\n{n:Notburga Aschenbrenner}
Bis bald\\n{n:Jost}
Mit bestem Dank\\n{n:Irmgard Pölking}\\n{a:Fasanenweg 9}\\n59065 Hamm
Freundliche Grüße\\n{n:Bastian Römhild}\\nVertrieb\\n{p:+49 561 7730918}
According to {n:Meredith Langford}, the valve had been leaking for weeks.
{n:Callum Fraser} replaced the gasket before lunch.
We hired {n:Ngozi Adebayo} as our new site engineer.
The complaint was filed by {n:Terrence Boyd} last Tuesday.
Nobody told {n:Imogen Hartley} that the meeting had moved.
{n:Mrs |Pemberton} asked for a copy of the certificate.
Speak to {n:Dr |Anselm Kirkbride} before you touch the boiler.
My colleague {n:Rosalind Tate} will send the drawings tomorrow.
{n:Desmond Achebe} and {n:Wilma Prescott} took the measurements.
The award went to {n:Professor |Lakshmi Venkataraman}.
Best,\\n{n:Gwendolyn Ashby}
Thanks again, {n:Rupert}
Dear {n:Ms |Okonkwo}, your order has shipped.
{n:Bryony Castle} lives at {a:47 Wharf Lane} in Whitby.
Der Installateur {n:Kazimierz Wrona} wohnt in der {a:Goldammerstraße 31}.
Geliefert wird an {a:Dieselstraße 18}, Halle C.
Das Labor ist umgezogen: {a:Rudolf-Virchow-Str. 7}, 37073 Göttingen.
Wir treffen uns vor dem Eingang {a:Marienplatz 2}.
Der Unfall geschah in Höhe {a:Hannoversche Straße 88}.
Sein letzter bekannter Wohnsitz war {a:Am Wasserturm 14}.
Zu vermieten: Altbau, {a:Kornblumenweg 3b}, zwei Zimmer.
Bitte klingeln bei {n:Möllmann}, {a:Hinter den Höfen 6}, zweiter Hof.
Unsere Filiale {a:Lange Gasse 41} schließt im Juni.
Das Päckchen liegt beim Nachbarn in der {a:Eschenallee 112}.
Rettungswagen zum {a:Bremer Damm 5}, dritter Stock.
Firmensitz ist seit April {a:Zum Alten Speicher 11} in Vegesack.
Fahren Sie bis zur {a:Von-Humboldt-Straße 64} und dann links.
Abholung ab 14 Uhr, {a:Nelkenstieg 8}.
Eigentümerin des Hauses {a:Schützenwall 27} ist {n:Edeltraud Krupp}.
Die Werkstatt findet man {a:An der Ziegelei 4}.
Bitte liefern Sie die Ersatzteile in die {a:Zeppelinstr. 90}.
Neue Adresse ab März: {a:Sudetenring 15a}, 84478 Waldkraiburg.
Der Antragsteller wohnt {a:Unter den Birken 2}, bei seiner Schwester.
Am {a:Münchner Ring 130} entsteht ein neues Rechenzentrum.
Die Akten lagern in der {a:Alte Ziegelgasse 19}.
Treffpunkt ist um acht Uhr {a:Fischmarkt 1}.
Ihr Paket wurde an {a:Zehntscheuerweg 23} zugestellt.
Der Gutachter besichtigte das Gebäude {a:Kapellenberg 12} gestern.
Rechnungsempfänger: Stadtwerke, {a:Turmstraße 50}.
The sample was posted to {a:9 Foundry Close}, Derby.
Head office: {a:221 Lansdowne Road}, Dublin.
Turn right at {a:16 Chapel Street} and park behind the mill.
Our tenant at {a:5 Orchard Crescent} has not paid since June.
Please collect the crate from {a:73 Old Mill Lane}.
The plant is located at {a:310 Riverside Drive}.
They moved from {a:28 Cobden Terrace} to {a:4 Priory Gardens}.
Send spare parts to {a:150 Canal Street}, second floor.
Mein Handy ist kaputt, ruf bitte die {p:02302 914477} an.
Festnetz: {p:0228/617-3340}, abends auch mobil unter {p:0175 3321906}.
Die Störungsstelle hat die Nummer {p:0800 5523199}.
Unter {p:+49 (0)231 4478-120} läuft nur ein Band.
Im Notfall {p:089 7734 2210} wählen!
Durchwahl Labor: {p:06131 20948-77}
Zwei Anrufe in Abwesenheit von {p:+49 1522 8841037}.
Faxen Sie den Bogen an {p:0451-778812}.
{n:Roswitha Hakenbeck} ist telefonisch unter {p:0385 60217} erreichbar.
Rückruf erbeten: {p:04131 7729905}, ab 17 Uhr.
Wegen der Pumpe bitte {p:0541.330.8874} anrufen.
Die Pforte erreichen Sie über {p:0049 3641 558120}.
Für Österreich gilt {p:+43 662 872190}.
Neuer Anschluss im Lager: {p:(0203) 44 81 90}.
Handwerker gesucht! Bitte melden: {p:0162/9903471}.
Call me back on {p:+44 161 496 0182} before noon.
Our hotline is {p:020 7946 0831}.
For spare parts dial {p:+1 415-555-0142}.
Her mobile number changed to {p:+44 7700 900461}.
Fax {p:(312) 555-0188} is out of order.
Tel. {p:07121 443319} oder E-Mail an {e:leitwarte@stadtwerke.example}.
Das Formular geht an {e:gisela.overhoff@kreis.example}.
Newsletter abbestellen: {e:abmelden@brief.example}
{e:t.hinz@ofenbau.example} hat geantwortet.
Bitte setzen Sie {e:qm-team@werk7.example} in Kopie.
Meine private Mail lautet {e:hanne_1979@postfach.example}.
Wer Fehler findet, schreibt an {e:redaktion(at)heft.example}.
Die Logdateien bitte an {e:support+log@server.example} schicken.
Kopie an {e:buchhaltung [at] firma [punkt] example}
Den Link habe ich von {e:olaf.kemper@schule.example}.
Rechnungen nimmt nur {e:Rechnung@Einkauf.example} an.
Anfragen zum Prüfstand: {e:pruefstand-2@labor.example}
Please reply to {e:maintenance@plant.example} only.
Her address is {e:j.abernathy@mail.example}.
The logs were sent by {e:root@gateway.example}.
Write to {e:claims@insurer.example} or phone {p:0113 496 0774}.
Unzustellbar: {e:e.vonderheide@verein.example}
Kontakt über {e:info@brunnenbau.example}, Telefon {p:05251 77340}.
{n:Sören Lüders} <{e:lueders@reederei.example}> schrieb am 4.5.:
Absender war {e:noreply@shop.example}.
Mein Konto lautet {i}, die Bank ist bekannt.
Überweisen Sie 120 Euro auf {i}.
Im Personalausweis steht die Nummer {i}.
Das Finanzamt führt sie unter {i}.
Die Rentenversicherung vergab {i} schon 1991.
Bitte tragen Sie {i} in Feld 12 ein.
Steuerliche Identifikationsnummer: {i}
Abbuchung von {i} am Monatsersten.
Sein Reisepass {i} ist abgelaufen.
Spendenkonto {i}, Stichwort Dachstuhl.
Lohnsteuerbescheinigung zu {i} fehlt noch.
Die Miete geht wie immer auf das Konto {i}.
Als Nachweis diente der Ausweis {i}.
{n:Gerlinde Haverkamp}, Versicherungsnummer {i}, ist seit Mai bei uns.
Please wire the deposit to {i}.
The refund went to account {i}.
Her passport number is {i}.
Kontoinhaber {n:Veit Stolze}, IBAN {i}
Kennung {i} wurde im Portal bestätigt.
Auf dem Bescheid fand ich die Nummer {i}.
Gutschrift zugunsten {i} ausgeführt.
Erika braucht für den Antrag noch {i}.|{n:Erika}
Das Lohnbüro fragt nach {i} und nach dem Geburtsdatum.
Dauerauftrag an {i} geändert.
SV-Ausweis: {i}
Kunde;Ort;Telefon\\n{n:Hartwig Böse};Soest;{p:02921 33871}\\n{n:Meike Tamm};Jever;{p:04461 90217}
Nachname, Vorname | Straße\\n{n:Engelhardt, Lore} | {a:Weinbergstraße 17}
{"besteller": "{n:Arno Veltins}", "email": "{e:veltins@holz.example}"}
{"owner": "{n:Phoebe Marchetti}", "phone": "{p:+44 20 7946 0415}"}
Rolle: Gutachter; Name: {n:Wendelin Kropp}; Mobil: {p:0151 22847719}
Besucher heute: {n:Alma Richartz}, {n:Ove Knudsen}, {n:Frau |Tenbrink}
Schichtführer: {n:Ilias Papadakis}
Der Kunde {n:Miroslav Havranek}, {a:Planckstraße 36}, verlangt Ersatz.
Vermieterin: {n:Adelheid Wörner}, {a:Obere Marktgasse 5}, 73728 Esslingen, {p:0711 4590127}
Die Bolzen wurden mit 45 Nm angezogen und markiert.
Im Winter friert der Bach am Werk regelmäßig zu.
Das Getriebe der Baureihe 7 läuft leiser als erwartet.
Die Goethe-Ausgabe steht im Regal neben dem Atlas.
Am Montag bleibt die Kantine geschlossen.
Der Bunsenbrenner erreicht rund 1500 °C.
Bestellnummer 4711-0815-22 ist nicht mehr lieferbar.
Die Röntgenprüfung ergab keine Risse.
Seite 12, Abschnitt 4.3 beschreibt den Ablauf.
Das Kochbuch und der Fischer-Dübel lagen auf dem Tisch.
Für die Regelung sorgt ein Ventil mit Feder und Membran.
Die Verordnung (EU) 2016/679 gilt seit Mai 2018.
Charge 20240117-03 wurde freigegeben, Los 88 gesperrt.
Diesel ist im Vergleich zu Benzin teurer geworden.
Die Uhrzeit 12:45 steht auf dem Display.
Der Bauer und der Müller sind alte Berufe.
An der Mosel beginnt im September die Weinlese.
The boiler pressure dropped to 3 bar overnight.
Version 2.14.0 fixes a crash in the report viewer.
The bridge was closed for repairs in October.
Spring and summer are the busiest months for the plant.
Order 00123-45678-90 could not be found.
Das Ohmsche Gesetz verknüpft Strom und Spannung.
Die Anlage Nord meldet Störung 302 an Kanal 7.
Wasser, Strom und Gas werden getrennt abgerechnet.
"""

#: A second set, written after the table was finished and not used to change it.
UNSEEN = """
Die Abnahme übernahm diesmal {n:Gerold Wichmann}, weil der Chef krank war.
Nachmittags telefonierte ich lange mit {n:Marlene Sprenger} aus der Buchhaltung.
Der Betriebsrat wählte {n:Hakan Toprak} zum Sprecher.
{n:Frau |Eickhoff} hat das Ventil bereits bestellt.
An der Pressekonferenz nahmen {n:Ansgar Hüls} und {n:Teresa Monti} teil.
Falls {n:Herr |Kalthoff} anruft, bin ich in der Werkstatt.
Die Schweißnähte prüft {n:Jannik Overhage} mit Ultraschall.
Im Protokoll fehlt die Unterschrift von {n:Wolfram Siebert}.
{n:Dorothea Lampe} leitete den Versuch, {n:P. Rennert} schrieb mit.
Kennt jemand die Adresse von {n:Friedhelm Tacke}?
Unsere Auszubildende {n:Shirin Rahimi} baut den Prüfstand um.
Der Vermieter, {n:Heribert Nagel}, wohnt {a:Am Bleichgraben 7}.
Das teilte {n:Staatssekretärin |Beatrix Sander} am Freitag mit.
Herzlichst\\n{n:Cordula Weidlich}
Lieber {n:Konstantin}, bitte bring die Schlüssel mit.
{n:Terhart, Sonja} (Einkauf) hat zugesagt.
Beim Abbau half auch {n:Nachbar |Wessels}.
Ohne die Notizen von {n:Magnus Ahlers} wären wir verloren.
Rückgabe an {n:Tilman Roloff}, {a:Kiefernweg 33}, 29525 Uelzen.
{n:Hannelore Pütz} erreichte man nie, auch nicht unter {p:0202 7719044}.
Fragen zur Charge beantwortet {n:Dr. |Ruth Angermann} ({e:ruth.angermann@chemie.example}).
We owe the idea to {n:Harold Winslow} and {n:Beatrice Okafor}.
{n:Ms |Delacroix} will chair the session on Thursday.
The gauge was read by {n:Tobin Marsh} twice a day.
After the accident {n:Leila Haddad} called the control room.
Sincerely,\\n{n:Cyril Dunmore}\\n{a:18 Harcourt Road}
Contact {n:Nadia Petrov} on {p:+44 20 7946 0777}.
Our office moved to {a:62 Granary Row} last spring.
Sie finden uns in der {a:Sophienstraße 21}, gleich neben der Post.
Der Tatort liegt {a:Hinter der Kelter 4}.
Umleitung ab {a:Dresdner Straße 155} bis zum Kreisel.
Wer die Nummer {p:0911/553 20 17} wählt, landet beim Notdienst.
SMS bitte an {p:0170 4492018}.
Antworten Sie ausschließlich an {e:umfrage2026@institut.example}.
Die Kaution wurde auf {i} eingezahlt.
Geben Sie beim Zoll {i} an.
Die Kupplung läuft trocken und pfeift bei Kälte.
Am Nordtor wird im Herbst ein neuer Kran montiert.
Kapitel 7 behandelt Werkstoffe, Kapitel 8 Schmierung.
The red lamp means that the pump has stopped.
Die Messreihe 12 wurde ohne Befund beendet.
Zwei Bolzen M12 und eine Mutter fehlen noch.
Die Schicht beginnt um sechs und endet um zwei.
Der Zander-Filter und das Otto-Verfahren gelten als veraltet.
"""
