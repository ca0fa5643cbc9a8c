"""Word lists of the personal-data labelers."""

# Frequent given names of English, German, French and Spanish speakers, and some from elsewhere.
GIVEN_NAMES = """Aaron Adam Ahmed Alan Albert Alejandro Alexander Alfred Alice Amanda Amelia Amy Ana Andrea Andreas Andrew Angela Anita Anna Anne Anthony Antonio Barbara Benjamin Bernard Brian Carlos Carmen
Carol Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Clara Claudia Daniel David Deborah Dennis Diego Dieter Donald Dorothy Edward Elena Elizabeth Ellen Emily Emma Eric Eva Felix
Fernando Florence Frances Francisco Frank Franz Fritz Gabriel George Gerhard Grace Hannah Hans Heinrich Helen Helga Henri Henry Ibrahim Ingrid Isabel Jack Jacob Jacques James Jane Javier Jean Jennifer Jessica
Joan John Jonas Jorge Joseph Juan Julia Juliette Karen Karin Karl Katharina Kenneth Kevin Klaus Laura Lena Linda Lisa Louis Lucas Lucy Luis Manuel Marco Margaret Maria Marie Mark Martin Mary Matthew Max
Michael Michelle Miguel Mohammed Monika Nancy Nicholas Nicole Oliver Olivia Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Ralf Rebecca Richard Robert Roger Rosa Ruth Samuel Sandra Sarah Sofia
Sophie Stefan Stephen Susan Teresa Thomas Timothy Ursula Victor Walter William Wolfgang""".split()
# Words that end (or, joined to a name, form) a street address.
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Square Court Way Terrace".split()
STREET_ENDINGS = "straße strasse str weg platz gasse allee".split()
STREETS_BEFORE = "Rue Avenue Boulevard Calle Avenida Plaza Place".split()
# Countries whose account numbers begin with their code.
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
